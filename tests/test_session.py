import os
import subprocess
import sys

import pytest

from proseloom import session


class Stub:
    """A session of another master, as far as shared_dir looks at it."""

    def __init__(self, master, named=None):
        self.master, self.sparkContext, self.conf, self.named = master, self, self, named

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.named or default


def test_shared_folder():
    assert session.shared_dir(Stub("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert session.shared_dir(Stub("local[4]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            session.shared_dir(Stub(master))


def test_written_tables_can_be_dropped(spark):
    df = session.written(spark.range(5), "five")
    path = df.inputFiles()[0]
    assert df.count() == 5 and os.path.exists(path.removeprefix("file://"))
    assert session.drop_written(spark) >= 1 and not os.path.exists(path.removeprefix("file://"))


def test_spread_is_a_setting(spark):
    df = spark.range(0, 10, 1, 3)
    assert session.spread(df).rdd.getNumPartitions() == 3
    spark.conf.set(session.SPREAD_CONF, "7")
    try:
        assert session.spread(df).rdd.getNumPartitions() == 7
    finally:
        spark.conf.unset(session.SPREAD_CONF)


def test_entry_without_the_optional_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # a left-over folder of the subpackage is no subpackage
    script = f"import sys; sys.path.insert(0, {root!r}); sys.modules['proseloom.llm.queries'] = None; import __spark_entry__ as e; print(len(e.queries()) >= 40, len(e.oracle_sql()) > 20)"
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=tmp_path, timeout=120)
    assert out.stdout.split() == ["True", "True"], out.stderr


def test_the_package_can_be_shipped(spark):
    import zipfile

    names = zipfile.ZipFile(session.ship(spark)).namelist()
    assert "proseloom/session.py" in names and "proseloom/operators/detect.py" in names
