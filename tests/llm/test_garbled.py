import pytest

from proseloom.llm.garbled import CHAINS, NARROW, UNIT, WHOLE, WIDE, decode, encode, forms, garbled_tokens, restore_text, restored, tokens, visible

FIELDS = [("text", False), ("html", True)]
CLEAN = ["la fenêtre où le modèle a été corrigé", "größere Lücke für jede Änderung", "очищенные измерения, обычные настройки", "それぞれのセンサー。", "the farmer’s son – at home"]


def garble(text, *chain):
    for a, b in chain:
        text = decode(encode(text, a), b)
    return text


@pytest.fixture(scope="module")
def cases():
    wrong = [
        garble(CLEAN[0], ("utf-8", "latin-1")), garble(CLEAN[1], ("utf-8", "windows-1252")), garble(CLEAN[2], ("utf-8", "windows-1252")),
        garble(CLEAN[0], ("utf-8", "windows-1252"), ("utf-8", "windows-1252")), garble(CLEAN[1], ("windows-1252", "cp437")),
        garble(CLEAN[2], ("koi8_r", "cp1251")), garble(CLEAN[3], ("utf-8", "latin-1")), garble(CLEAN[0], ("utf-8", "mac_roman")),
        CLEAN[0].encode("latin-1").decode("utf-8", "replace"), garble(CLEAN[4], ("utf-8", "windows-1252")),
    ]
    rows = [(i, t, None) for i, t in enumerate(CLEAN * 40)]
    rows += [(1000 + i, t, f"<style>Ã©</style><p title='Ã©'>{t}</p>") for i, t in enumerate(wrong)] + [(1000, wrong[0], None)]
    sound = ["COORDENAÇÃO E PRODUÇÃO: SÃO DUAS SEÇÕES.", "√2 ≈ 1,414 und ∆x ≤ 3 µm.", "Ångström, Õhtu and Ðorvik", "", "plain"]
    return rows + [(2000 + i, t, "<!-- Ã© -->&eacute;t&eacute;") for i, t in enumerate(sound)] + [(3000, None, "d&Atilde;&copy;j&agrave;")], wrong


def test_found_and_restored(spark, cases):
    rows, wrong = cases
    df = spark.createDataFrame(rows, "key long, text string, html string")
    found = garbled_tokens(df, "key", FIELDS)
    keys = {(r.key, r.field_name) for r in found.collect()}
    want = {(1000 + i, f) for i in range(len(wrong)) for f in ("text", "html")} | {(3000, "html")}
    assert keys == want
    back = {(r.key, r.field_name): r.restored for r in restored(df, found, "key", FIELDS).collect()}
    origin = [0, 1, 2, 0, 1, 2, 3, 0, 0, 4]
    for i, o in enumerate(origin):
        if i != 8:  # what was lost can only be put back where one word fits
            assert back[1000 + i, "text"] == CLEAN[o]
    assert back[1001, "html"] == f"<style>Ã©</style><p title='Ã©'>{CLEAN[1]}</p>"


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "")], "key long, text string, html string")
    assert garbled_tokens(df, "key", FIELDS).count() == 0
    assert garbled_tokens(df.limit(0), "key", FIELDS).count() == 0


def test_visible_and_tokens():
    assert visible("<b>&eacute;</b><script>é</script>", True).strip() == "é"
    assert tokens("plain") == set() and ("Ã©", 2) in tokens("cafÃ©s")


def test_rare_originals_beside_the_same_chain(spark):
    chain, other = ("windows-1252", "cp437"), ("windows-1252", "mac_roman")
    rows = [(i, "die größere Lücke", None) for i in range(40)] + [(100 + i, "eine sprödere Prüfung", None) for i in range(3)]
    rows += [(200, garble("die größere sprödere", chain), None), (201, garble("die größere", chain) + " " + garble("Prüfung", other), None), (202, garble("Prüfung", chain), None)]
    df = spark.createDataFrame(rows, "key long, text string, html string")
    found = garbled_tokens(df, "key", FIELDS)
    back = {r.key: r.restored for r in restored(df, found, "key", FIELDS).collect()}
    # rare words: restored beside the same chain, left beside another one and alone
    assert back == {200: "die größere sprödere", 201: "die größere " + garble("Prüfung", other)}
    assert {r.key for r in found.collect()} == {200, 201}


def test_every_chain_is_in_the_forms():
    made = {}
    for form, _, chains in forms("fenêtre", WHOLE):
        for c in chains:
            made[c] = form
    for d in WIDE:
        once = "fenêtre".encode().decode({"windows-1252": "cp1252"}.get(d, d))
        assert made[CHAINS[d,]] == once
        for e in WIDE:
            assert made[CHAINS[d, e]] == decode(once.encode(), e)
    for a, b in NARROW:
        if encode("fenêtre", a) and decode(encode("fenêtre", a), b) != "fenêtre":
            assert made[CHAINS["narrow", a, b]] == decode(encode("fenêtre", a), b)
    assert len(set(CHAINS.values())) == len(CHAINS)


@pytest.mark.parametrize("d", WIDE)
@pytest.mark.parametrize("e", WIDE)
def test_characters_garbled_twice_inside_words(d, e):
    # four characters in a row make eight units and more, by any two of the encodings
    word = "xy" + decode(decode("éèüß".encode(), d).encode(), e) + "z"
    if "\ufffd" in word:
        return  # bytes were lost; such fields are found by that sign
    found = tokens(word)
    pairs = {}
    for c in "éèüß":
        for form, kind, chains in forms(c, 0):
            if CHAINS[d, e] in chains:
                assert (form, UNIT) in found and kind == UNIT
                pairs[form] = c
    assert restore_text(word, pairs, False) == "xyéèüßz"


def test_units_beside_kana():
    text = "それぞれcafÃ©のセンサー"
    assert ("Ã©", UNIT) in tokens(text) and ("cafÃ©", WHOLE) in tokens(text)
    assert restore_text(text, {"Ã©": "é"}, False) == "それぞれcaféのセンサー"


def test_sound_markup_stays():
    pairs = {"Ã©": "é", "â€”": "—", "Ã©<": "x"}
    assert restore_text("a&nbsp;b &copy; Ã© &quot;x&quot; &amp;Ã© <b title='Ã©'>&Atilde;&copy;&Atilde;</b> â€”", pairs, True) == "a&nbsp;b &copy; é &quot;x&quot; &amp;é <b title='Ã©'>é&Atilde;</b> —"
    assert restore_text("no &lt;tags&gt; Ã©", {"Ã©": "<"}, True) == "no &lt;tags&gt; &lt;"


def test_one_original_for_a_token_of_two_kinds(spark):
    df = spark.createDataFrame([(1, "xx Ã© yy", None)], "key long, text string, html string")
    found = spark.createDataFrame([(1, "text", "Ã©", 1, "word"), (1, "text", "Ã©", 2, "é"), (1, "text", "Ã©", 2, "e"), (1, "text", "\ufffd", 0, None)], "key long, field_name string, token string, kind int, original string")
    r = restored(df, found, "key", FIELDS).first()
    assert (r.restored, r.n_garbled, r.n_restored, r.n_traces) == ("xx é yy", 2, 1, 1)


def test_traces_have_no_original(spark):
    df = spark.createDataFrame([(1, "lost \ufffd here", None), (2, "fine", None)], "key long, text string, html string")
    assert [(r.key, r.token, r.original) for r in garbled_tokens(df, "key", FIELDS).collect()] == [(1, "\ufffd", None)]


def test_a_frequent_garbled_sign_is_dealt_to_many_tasks(spark):
    rows = [(i, "it’s a farmer’s word", None) for i in range(300)] + [(1000 + i, garble("it’s here", ("utf-8", "windows-1252")), None) for i in range(90)]
    df = spark.createDataFrame(rows, "key long, text string, html string")
    found = garbled_tokens(df, "key", FIELDS)
    assert {r.key for r in found.collect()} == {1000 + i for i in range(90)}


def test_a_quotation_mark_that_lost_a_byte(spark):
    wrong = "the “word”".encode().decode("cp1252", "replace")
    df = spark.createDataFrame([(i, "a “quoted” word", None) for i in range(20)] + [(100, wrong, None)], "key long, text string, html string")
    r = restored(df, garbled_tokens(df, "key", FIELDS), "key", FIELDS).first()
    assert r.restored == "the “word”" and r.n_restored == 2
