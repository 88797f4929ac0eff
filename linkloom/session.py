"""Session set-up, table access and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: "weakref.WeakKeyDictionary[SparkSession, list[str]]" = weakref.WeakKeyDictionary()


def get_spark(app: str = "linkloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on; `conf` overrides any default (`_` stands for `.`)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    defaults.update({k.replace("_", "."): str(v) for k, v in conf.items()})
    for k, v in defaults.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir`, or a temporary one where it is unset (local tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='linkloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back.

    It ends the lineage (a lost executor costs a re-read, never a recomputation), gives the optimizer true
    sizes and is compressed, which a checkpoint's serialized rows are not. Shuffle files of the write go when it is done. Loops call `drop`
    on what they no longer need; the rest goes with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkloom-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    keep(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._linkloom_path = path
    return out


def keep(spark: SparkSession, path: str) -> str:
    """Remembers a written path until the session ends, when it is deleted."""
    _made.setdefault(spark, []).append(path)
    return path


def drop(*dfs: DataFrame) -> None:
    """Deletes what `cut` wrote for these DataFrames; others are left alone."""
    for df in dfs:
        if path := getattr(df, "_linkloom_path", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made.get(spark, []):
        _made[spark].remove(path)


def drop_all(spark: SparkSession) -> None:
    """Deletes every table that `cut` wrote in this session."""
    for path in list(_made.get(spark, [])):
        _delete(spark, path)


@atexit.register
def _at_exit() -> None:
    for spark in list(_made):
        try:
            drop_all(spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass
