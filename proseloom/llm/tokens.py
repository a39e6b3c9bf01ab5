"""Encoding of a corpus with a public tokenizer, by reuse of content-defined chunks over the whole corpus.

1. A text's bytes are cut at places where no word of the tokenizer's pattern can go on (``safe``), and of these at the ones
   where a hash over the window of bytes before them says so, hence copied passages are cut alike wherever they stand.
2. The hashes of all chunks of all texts are counted over the corpus: one shuffle of hashes, not of texts. Chunks that come
   more than once are encoded once, and become one table (``ChunkTable``) that every worker gets. Its size is
   bounded by TABLE_CHUNKS and HIGH; if more chunks are shared than it holds, the most frequent ones are in it, and the
   rest are encoded where they stand, with the same result.
3. Texts are put together from the table's ids and, between them, from what the tokenizer makes of the passages the table
   does not hold. A chunk is taken from the table only if its bytes are the same, never by its hash alone.
4. Joins. Safe places need no repair: visible ASCII before ASCII white space (the only look-ahead concerns white space), a
   letter beside a digit, an ideographic full stop before a kana or ideograph. A stretch of more than HARD_BYTES
   without one is cut anyway, at characters, by the same hash, and each of those joins is repaired: the words at
   the join are encoded again, from the last word that is sure on the left, until a word of the re-encoding begins where a
   word of the right chunk begins; from there on both agree.

All of this is vectorised over the buffers of a batch; only passages the table does not hold become Python strings.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text;
repeated rows are encoded alike; other columns are carried along; a column named as the output is replaced.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseloom.session import written

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Fixed value: the pattern that belongs to the byte-level vocabularies, as their description gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: One safe place in 2**CHUNK_BITS is a cut; chunks of LOW to HIGH bytes can be shared; stretches without a safe place are cut from HARD_BYTES on.
CHUNK_BITS, LOW, HIGH, HARD_BYTES = 1, 8, 64, 1024
#: Most chunks in the shared table (some 100 bytes each), bytes of texts handled at a time, and the least run of reused bytes that is worth a call of the tokenizer less.
TABLE_CHUNKS, BLOCK_BYTES, LEAST_RUN = 1 << 17, 1 << 20, 24
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
#: The tokenizer's white space is the Unicode property; this library's own class has a few control characters more.
_WORDS = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s+", r"\p{White_Space}+").replace(r"\S", r"\P{White_Space}"))

# kinds of bytes: blank, digit, letter, other visible ASCII, and the rest
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[48:58], _KIND[65:91], _KIND[97:123] = 1, 2, 3, 3
_KIND[[i for i in range(33, 127) if not _KIND[i]]] = 4
_SAFE = np.zeros(64, dtype=bool)
_SAFE[[2 * 8 + 1, 3 * 8 + 1, 4 * 8 + 1, 2 * 8 + 3, 3 * 8 + 2]] = True


def safe_places(b: np.ndarray) -> np.ndarray:
    """Places that no word of the tokenizer spans, whatever stands around them."""
    kind = _KIND[b]
    at = _SAFE[(kind[:-1] << 3) + kind[1:]]
    if len(b) > 4 and (b == 0xE3).any():  # the ideographic full stop before a kana or an ideograph
        p, q = b[3:-1], b[4:]
        kana = (p == 0xE3) & (((q == 0x81) & (np.append(b[5:], 0) > 0x80)) | ((q == 0x82) & (np.append(b[5:], 0) > 0xA0)))
        at[2:-1] |= (b[:-4] == 0xE3) & (b[1:-3] == 0x80) & (b[2:-2] == 0x82) & (kana | ((p == 0xE4) & (q >= 0xB8)) | ((p > 0xE4) & (p < 0xE9)))
    return np.flatnonzero(at) + 1


def _windows(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer."""
    return np.ndarray(shape=(max(0, len(b) - 7),), dtype="<u8", buffer=b, strides=(1,))


def chosen_cuts(b: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
    """Those of ``places`` where the hash of the eight bytes before them ends in zeros."""
    places = places[places >= 8]
    if not len(places) or not bits:
        return places
    with np.errstate(over="ignore"):
        return places[(_windows(b)[places - 8] * _MULTIPLIERS[0]) >> np.uint64(64 - bits) == 0]


@dataclass
class Chunks:
    """The chunks of a block of texts: their starts and sizes, and of those that can be shared the hash and the bytes as eight integers."""

    start: np.ndarray
    size: np.ndarray
    can: np.ndarray
    hash: np.ndarray
    words: np.ndarray


def chunks_of(b: np.ndarray, starts: np.ndarray, bits: int = CHUNK_BITS) -> Chunks:
    """``starts`` are the offsets at which texts begin; no chunk goes over one of them."""
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[chosen_cuts(b, safe_places(b), bits)] = True
    edge[starts] = edge[0] = edge[-1] = True
    edges = np.flatnonzero(edge)
    start, size = edges[:-1], np.diff(edges)
    can = (size >= LOW) & (size <= HIGH)
    at, n, window = start[can], size[can], _windows(b)
    words = np.empty((len(at), HIGH // 8), dtype=np.uint64)
    h = n.astype(np.uint64) * _MULTIPLIERS[3]
    with np.errstate(over="ignore"):
        for k in range(HIGH // 8):
            words[:, k] = window[at + np.minimum(8 * k, n - 8)] if len(at) else 0
            h = (h ^ words[:, k]) * _MULTIPLIERS[k % 4]
            h ^= h >> np.uint64(29)
        h *= _MULTIPLIERS[1]
    return Chunks(start, size, can, h, words)


@dataclass
class ChunkTable:
    """Chunks by hash: their sizes and bytes, and their ids one after the other."""

    hash: np.ndarray
    size: np.ndarray
    words: np.ndarray
    ids: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, chunks: list[bytes], ids: list[bytes]) -> ChunkTable:
        b = np.frombuffer(b"".join(chunks), dtype=np.uint8)
        starts = np.append(0, np.cumsum([len(c) for c in chunks])).astype(np.int64)
        if not chunks:
            none = np.zeros(0, dtype=np.uint64)
            return cls(none, np.zeros(0, dtype=np.int64), np.zeros((0, HIGH // 8), dtype=np.uint64), np.zeros(0, dtype=np.uint16), np.zeros(1, dtype=np.int64))
        found = chunks_of(b, starts[:-1], bits=63)
        whole = np.searchsorted(starts, found.start)
        whole = np.flatnonzero((starts[np.minimum(whole, len(starts) - 1)] == found.start) & found.can & (np.diff(starts)[np.minimum(whole, len(chunks) - 1)] == found.size))
        own, at = np.searchsorted(starts, found.start[whole]), np.cumsum(found.can)[whole] - 1
        h, pick = np.unique(found.hash[at], return_index=True)
        parts = [np.frombuffer(ids[i], dtype=np.uint16) for i in own[pick]]
        return cls(h, found.size[whole][pick], found.words[at][pick], np.concatenate([*parts, np.zeros(0, dtype=np.uint16)]), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64))

    def find(self, c: Chunks) -> np.ndarray:
        """For each chunk its row of this table, -1 where it is not in it."""
        row = np.full(len(c.start), -1, dtype=np.int64)
        if len(self.hash) and len(c.hash):
            i = np.minimum(np.searchsorted(self.hash, c.hash), len(self.hash) - 1)
            may = np.flatnonzero(self.hash[i] == c.hash)
            i = i[may]
            same = (self.size[i] == c.size[c.can][may]) & (self.words[i] == c.words[may]).all(1)
            row[np.flatnonzero(c.can)[may[same]]] = i[same]
        return row


class Tokenizer:
    """Encodes texts as 16-bit ids; ``path`` is a vocabulary file of base64 tokens and ranks."""

    def __init__(self, path: str, bits: int = CHUNK_BITS, hard: int = HARD_BYTES) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) > 0xFFFF:
            raise ValueError("ids of more than 16 bits")
        self.plain = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.bits, self.hard = bits, hard

    def direct(self, data: bytes) -> bytes:
        return array("H", self.plain.encode_ordinary(data.decode())).tobytes()

    def passage(self, data: bytes) -> bytes:
        """Ids of what the table does not hold."""
        if len(data) <= self.hard:
            return self.direct(data)
        at = np.concatenate([[0], safe_places(np.frombuffer(data, dtype=np.uint8)), [len(data)]])
        out, begun = [], 0
        for i in np.flatnonzero(np.diff(at) > self.hard).tolist():
            a, z = int(at[i]), int(at[i + 1])
            out += [self.direct(data[begun:a]), self.repaired(data[a:z])]
            begun = z
        return b"".join([*out, self.direct(data[begun:])])

    def block(self, data: bytes, starts: np.ndarray, table: ChunkTable) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that stand one after the other in ``data`` and begin at ``starts``, and how many each has."""
        if not data:
            return np.zeros(0, dtype=np.uint16), np.zeros(len(starts), dtype=np.int64)
        b = np.frombuffer(data, dtype=np.uint8)
        c = chunks_of(b, starts, self.bits)
        row = table.find(c)
        hit = row >= 0
        begins = np.isin(c.start, starts)
        # runs of chunks that are in the table; short ones cost more than they save
        new = np.append(True, (hit[1:] != hit[:-1]) | begins[1:])
        run = np.cumsum(new) - 1
        hit &= np.add.reduceat(c.size, np.flatnonzero(new))[run] >= LEAST_RUN
        # a segment is a chunk of the table, or a passage between two of them
        first = np.flatnonzero(np.append(True, hit[1:] | hit[:-1] | begins[1:]))
        at, known = c.start[first], hit[first]
        ends = np.append(at[1:], len(data))
        source, count = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
        k = row[first][known]
        source[known], count[known] = table.first[k], table.first[k + 1] - table.first[k]
        made = [self.passage(data[x:y]) for x, y in zip(at[~known].tolist(), ends[~known].tolist())]
        count[~known] = [len(m) // 2 for m in made]
        source[~known] = len(table.ids) + np.cumsum(count[~known]) - count[~known]
        pool = np.concatenate([table.ids, np.frombuffer(b"".join(made), dtype=np.uint16)])
        total = np.append(0, np.cumsum(count))
        ids = pool[np.arange(total[-1]) + np.repeat(source - total[:-1], count)]
        places = total[np.searchsorted(at, np.append(starts, len(data)))]
        return ids, np.diff(places)

    def texts(self, column: pa.Array, table: ChunkTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the texts of a column, and how many each has, block by block."""
        for data, starts in blocks(column):
            yield self.block(data, starts, table)

    def repaired(self, data: bytes) -> bytes:
        """Ids of a long stretch without safe places: cut at characters by the hash, joins repaired."""
        b = np.frombuffer(data, dtype=np.uint8)
        places = np.flatnonzero((b & 0xC0) != 0x80)
        hashed = set(chosen_cuts(b, places, self.bits + 5).tolist())
        known: dict[bytes, bytes] = {}
        out, carry, last = [], "", 0
        for p in places[1:].tolist() + [len(data)]:
            if p < len(data) and not (p in hashed and p - last >= 32) and p - last < self.hard:
                continue
            carry = self._append(out, carry, data[last:p], known)
            last = p
        out.append(self._by_word(carry, known))
        return b"".join(out)

    def _known(self, data: bytes, known: dict[bytes, bytes]) -> bytes:
        if data not in known:
            known[data] = self.direct(data)
        return known[data]

    def _by_word(self, text: str, known: dict[bytes, bytes]) -> bytes:
        return b"".join(self._known(m.group().encode(), known) for m in _WORDS.finditer(text))

    @staticmethod
    def _sure(text: str, starts: list[int]) -> int:
        """The offset up to which the words read in ``text`` stay the same whatever follows it.

        The last word may go on, and a contraction looks at most three characters ahead.
        """
        i = len(starts) - 1
        while i > 0 and starts[i] > len(text) - 4:
            i -= 1
        return starts[i]

    def _append(self, out: list[bytes], carry: str, data: bytes, known: dict[bytes, bytes]) -> str:
        """Adds the ids of carry + data to ``out`` as far as they are sure; returns the text that is not."""
        text, ids = data.decode(), self._known(data, known)
        starts = [m.start() for m in _WORDS.finditer(text)]
        sure, begin = self._sure(text, starts), 0
        if carry:
            own, words = set(starts), []
            for m in _WORDS.finditer(carry + text):
                begin = m.start() - len(carry)
                if begin > sure or begin in own:
                    break
                words.append(m.group())
            if begin > sure or begin not in own:  # never in step: what is sure of both together, word by word
                both = carry + text
                sure = self._sure(both, [m.start() for m in _WORDS.finditer(both)])
                words = [m.group() for m in _WORDS.finditer(both) if m.start() < sure]
                out.extend(self._by_word(w, known) for w in words)
                return both[sure:]
            out.extend(self._by_word(w, known) for w in words)
        ends = np.append(0, np.cumsum(self.length[np.frombuffer(ids, dtype=np.uint16)]))
        x, y = np.searchsorted(ends, [len(text[:begin].encode()), len(text[:sure].encode())]).tolist()
        out.append(ids[2 * x : 2 * y])
        return text[max(begin, sure) :]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[bytes, np.ndarray]]:
    """The texts of a column as bytes of about ``most`` at a time, and where each begins; a null text is an empty one."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield (data[int(ends[i]) : int(ends[j])].to_pybytes() if data is not None else b""), ends[i:j] - ends[i]
        i = j


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """This worker's tokenizer; it outlives the task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


def chunk_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(h, n, chunk): how often each chunk stands in the texts; the bytes are there if it came twice within one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, texts = [], {}
            for data, starts in blocks(batch.column(0)):
                if not data:
                    continue
                c = chunks_of(np.frombuffer(data, dtype=np.uint8), starts)
                h, at, n = np.unique(c.hash, return_index=True, return_counts=True)
                hashes.append((h, n))
                start, size, twice = c.start[c.can][at], c.size[c.can][at], n > 1
                for key, a, s in zip(h[twice].tolist(), start[twice].tolist(), size[twice].tolist()):
                    if key not in texts:
                        texts[key] = data[a : a + s]
            if not hashes:
                continue
            every, n = (np.concatenate(x) for x in zip(*hashes))
            h, back = np.unique(every, return_inverse=True)
            total = np.bincount(back, n, len(h)).astype(np.int64)
            own = np.fromiter(texts, dtype=np.uint64, count=len(texts))
            # those with bytes on their own, so that the others need no column of them
            rest = ~np.isin(h, own)
            lone = int(rest.sum())
            order = np.searchsorted(h, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h[rest], own]).view(np.int64)), pa.array(np.concatenate([total[rest], total[order]])), pa.array([None] * lone + list(texts.values()), pa.binary())],
                names=["h", "n", "chunk"],
            )

    seen = df.select(F.col(f"`{text}`").alias("_text")).mapInArrow(run, "h long, n long, chunk binary")
    return seen.groupBy("h").agg(F.sum("n").alias("n"), F.max("chunk").alias("chunk"))


def shared_chunks(df: DataFrame, text: str = "text", path: str | None = None, most: int = TABLE_CHUNKS) -> ChunkTable:
    """The table of the chunks that come more than once, each encoded once; at most ``most``, the more frequent ones first."""
    path = path or vocabulary()
    counted = written(chunk_counts(df, text).where("n > 1 AND chunk IS NOT NULL"), "token-chunks")
    grade = F.floor(F.log2("n") * 8).cast("int")
    room, least, share = most, None, 1.0
    for r in counted.groupBy(grade.alias("g")).count().orderBy(F.desc("g")).collect():
        least, share = r.g, min(1.0, room / r["count"])
        room -= r["count"]
        if room <= 0:
            break
    if least is None:
        return ChunkTable.of([], [])
    part = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(share * (1 << 20))
    chosen = counted.where((grade > least) | ((grade == least) & part)).select("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [tokenizer(path).direct(c) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    rows = chosen.mapInArrow(run, "chunk binary, ids binary").collect()
    return ChunkTable.of([bytes(r.chunk) for r in rows], [bytes(r.ids) for r in rows])


def encode_texts(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", most: int = TABLE_CHUNKS) -> DataFrame:
    """``df`` with ``ids``, the list of token ids of ``text``, in place of ``text``. Only hashes of chunks are shuffled."""
    path = path or vocabulary()
    kept = [f for f in df.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    table = df.sparkSession.sparkContext.broadcast(shared_chunks(df, text, path, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shared = tokenizer(path), table.value
        for batch in batches:
            found = list(own.texts(batch.column(len(kept)), shared))
            offsets = np.append(0, np.cumsum(np.concatenate([n for _, n in found]) if found else [])).astype(np.int32)
            values = np.concatenate([i for i, _ in found]).astype(np.int32) if found else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=schema.names)

    chosen = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("_text"))
    return chosen.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, count: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of ``text`` in place of ``text``, by the tokenizer alone; null and empty texts count 0."""
    path = path or vocabulary()
    kept = [f for f in df.schema.fields if f.name not in (text, count)]
    schema = T.StructType([*kept, T.StructField(count, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = tokenizer(path).plain
        for batch in batches:
            found = [len(plain.encode_ordinary(t)) if t else 0 for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=schema.names)

    chosen = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("_text"))
    return chosen.mapInArrow(run, schema)
