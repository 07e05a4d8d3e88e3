"""Spark session and checkpoint-directory helpers.

Cluster jobs read ``spark.checkpoint.dir`` from the session; a private
scratch folder is created only when the setting is unset on a local
master (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "poolpick",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build one tuned for this library."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``poolpick`` importable in the Python workers (as ``--py-files`` would).

    Arrow-batched functions are pickled by reference to their module, so the
    workers must import the package; it is zipped once on the driver and
    added with ``SparkContext.addPyFile``, which Spark distributes to every
    executor. Idempotent per SparkContext.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="poolpick-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "poolpick"), "zip", root_dir=os.path.dirname(pkg_dir),
                                  base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one. Only a
    local master without that setting gets a fresh folder under the
    system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="poolpick-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    return f"{_tables(spark)}/{name}-{os.getpid()}-{next(_counter)}"


def _tables(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application; call it when no result is read any more."""
    jvm, path = spark.sparkContext._jvm, _tables(spark)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def dealt(df, *keys):
    """Rows dealt by ``keys`` over as many tasks as the session shuffles to, ahead of heavy work inside the rows.

    The number is given, so that narrow rows (few bytes, much work) are not put together again.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def tasks_for(spark: SparkSession, items: int, per_task: int) -> int:
    """Tasks for ``items`` pieces of work of ``per_task`` each; as many as ``dealt`` takes at least."""
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, -(-items // per_task))


def dealt_if_few(df, *keys):
    """``dealt`` for a scan with fewer splits than the cluster has cores (a file of one row group); a large scan stays as it is."""
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return dealt(df, *keys) if few else df


def materialise(df, name: str):
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where one expensive intermediate feeds several actions: it is
    computed once, its lineage is cut, and it survives executor loss
    (unlike a cache or a local checkpoint).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()
