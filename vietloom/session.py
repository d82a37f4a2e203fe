"""Session factory and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def get_session(app: str = "vietloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether all executors are this process, so that its disk is theirs."""
    m = spark.sparkContext.master
    return m == "local" or m.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder; on a cluster that would be another disk on each
    machine, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="vietloom-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


_scopes: list[list[tuple[SparkSession, str]]] = []


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors.

    The table stays for as long as results that read it may be wanted; inside of :func:`scratch` it goes at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vietloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch():
    """Deletes what :func:`written` made inside, once the block ends: results must have been taken by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
