"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: A setting of the session: how many parts ``spread`` makes of an input. Unset, as on a cluster, inputs keep the splits of the scan.
SPREAD_CONF = "spark.proseloom.spread"
_WRITTEN: list[str] = []


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", spread: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use; ``spread`` is for inputs of one small file."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("proseloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    if spread:
        spark.conf.set(SPREAD_CONF, str(spread))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local master (tests, a laptop) gets a folder of
    its own, which goes at the end of the process; any other master is an error, since its executors could not read it.
    """
    named = spark.sparkContext.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"proseloom-{os.getpid()}")
    if not os.path.isdir(own):
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new Parquet table in the shared folder and read back with column pruning and pushdown.

    The table stays until ``drop_written`` or the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_drop_at_exit)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that ``written`` has made in this process; call it when no result that reads them is needed any more."""
    jvm, n = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            drop_written(spark)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


def ship(spark: SparkSession) -> str:
    """Sends this package to the executors of a cluster on which it is not installed; returns the archive's path on the driver."""
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="proseloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(os.path.join(folder, "proseloom"), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)
    return archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as the session's ``spark.proseloom.spread`` says; as it is where that is unset."""
    parts = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(parts)) if parts else df


def distinct_by(df: DataFrame, key: str) -> DataFrame:
    """The distinct rows of ``df``, by one shuffle on ``key`` into as many parts as the session asks for.

    The parts are not merged afterwards by their size, since what follows costs much more than reading them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, 1), key).distinct()
