"""Session helpers: one place for the settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "linkloom") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("LINKLOOM_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders made in local mode, by application: ``spark.checkpoint.dir`` can't be set in a running session.
_LOCAL_FOLDERS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared file system); a machine-local
    temporary folder is only made when running in local mode and unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_FOLDERS.get(spark.sparkContext.applicationId)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):  # local-cluster has executors of its own
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="linkloom-ckpt-")
        _LOCAL_FOLDERS[spark.sparkContext.applicationId] = d
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never localCheckpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a *small* input over the cluster's cores before CPU-heavy
    per-row work (html regexes, BM25). A large input already has at least
    ``defaultParallelism`` splits and is returned unchanged: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def cut_lineage_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` plus the row count, observed during the same job."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    obs = Observation()
    out = cut_lineage(df.observe(obs, F.count(F.lit(1)).alias("n")))
    return out, int(obs.get["n"])


class co_partitioned:
    """``with co_partitioned(spark, n):`` run eager steps with
    ``spark.sql.shuffle.partitions = n`` and adaptive execution off (all
    restored on exit). Checkpoints taken inside keep their hash partitioning
    and sort order (an adaptive plan reports unknown ones), and every
    exchange uses the same ``n``, so joins between such tables move nothing.
    The runtime bloom filter is off too: it would scan the store's URL set
    at every step to build a filter too small for it."""

    SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled",
                "spark.sql.optimizer.runtime.bloomFilter.enabled")

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n = spark, n

    def __enter__(self):
        c = self.spark.conf
        self.old = [c.get(k, None) for k in self.SETTINGS]
        for k, v in zip(self.SETTINGS, (str(self.n), "false", "false")):
            c.set(k, v)
        return self

    def __exit__(self, *exc):
        for k, v in zip(self.SETTINGS, self.old):
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        return False


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``linkloom`` importable in the Python workers of this
    application (``addPyFile`` of a zip of the package, once per app).
    Needed by the operators that run Python inside tasks."""
    import shutil

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="linkloom-pkg-")
    archive = shutil.make_archive(os.path.join(out, "linkloom"), "zip", os.path.dirname(pkg), "linkloom")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)

