import glob

import pytest

from sparkloom.llm import _shared


def test_written_tables_and_cleaning(spark):
    df = spark.range(5).selectExpr("id", "array(id) as a")
    out = _shared.written(df, "some")
    assert out.count() == 5 and out.dtypes == df.dtypes
    path = _shared._tables[-1]
    assert path.startswith(_shared.shared_dir(spark)) and glob.glob(path)
    _shared._tables[:-1] = []
    _shared.clean(spark)
    assert not glob.glob(path) and not _shared._tables


class Session:
    def __init__(self, master):
        self.sparkContext = self
        self.master, self.conf = master, self

    def get(self, key, default):
        return default


def test_a_cluster_needs_a_shared_folder():
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError):
            _shared.shared_dir(Session(master))
    assert _shared.shared_dir(Session("local[2]")) == _shared.shared_dir(Session("local"))
