import pytest

from tocsin.session import checkpoint_dir


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)

    def set(self, key, value):
        self[key] = value


class _Context:
    def __init__(self, master):
        self.master = master
        self.dir = None

    def setCheckpointDir(self, path):
        self.dir = path


class _Session:
    def __init__(self, master, conf=None):
        self.conf = _Conf(conf or {})
        self.sparkContext = _Context(master)


def test_cluster_without_shared_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError):
        checkpoint_dir(_Session("yarn"))


def test_configured_checkpoint_dir_is_used():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert checkpoint_dir(s) == "hdfs:///shared/ckpt" and s.sparkContext.dir == "hdfs:///shared/ckpt"


def test_local_session_gets_its_own_scratch_folder():
    s = _Session("local[2]")
    path = checkpoint_dir(s)
    assert path and s.conf["spark.checkpoint.dir"] == path


def _folders(spark):
    import os
    return {f for f in os.listdir(spark.conf.get("spark.checkpoint.dir")) if f.startswith("tocsin-")}


def _cached(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_release_frees_what_queries_leave(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    from tocsin.session import checkpoint_dir, release
    checkpoint_dir(spark)
    release(spark)
    folders, cached = _folders(spark), _cached(spark)
    for name in ("episodes_dataset", "ingest_series", "loglik_adverse"):
        E.queries()[name](spark, SF_SMALL).count()
    assert _folders(spark) > folders and _cached(spark) > cached
    assert release(spark) > 0
    assert _folders(spark) == folders and _cached(spark) == cached


def test_scratch_frees_only_its_own(spark):
    from tocsin.session import checkpoint_dir, keep, materialize, release, scratch
    checkpoint_dir(spark)
    outer = materialize(spark.range(3), "outer")
    folders, cached = _folders(spark), _cached(spark)
    with scratch(spark):
        assert materialize(spark.range(4), "inner").count() == 4 and keep(spark.range(5)).count() == 5
        assert _folders(spark) > folders
    assert _folders(spark) == folders and _cached(spark) == cached and outer.count() == 3
    release(spark)


def test_stream_batches_leave_nothing(spark, tmp_path):
    from test_ingest_files import _make_folders
    from tocsin.session import checkpoint_dir
    from tocsin.streaming.ingest_stream import start_ingest_stream
    checkpoint_dir(spark)
    csv_dir, wb_dir = _make_folders(str(tmp_path))
    folders = _folders(spark)
    start_ingest_stream(spark, csv_dir, wb_dir, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                        available_now=True).awaitTermination(120)
    assert _folders(spark) == folders
