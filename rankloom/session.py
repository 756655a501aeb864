"""Session builder and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
_inside = threading.local()


def build_session(app: str = "rankloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, runtime skew handling and UTC timestamps.

    Broadcasts are left to Spark's own size checks, but for fitted tables that
    were counted first and lie within a fixed number of rows.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # methods above this size are never compiled by the JVM's JIT; wide projections
        # then run several times faster outside whole-stage code
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def together(spark: SparkSession, tasks: Sequence[Callable[[], T]], at_once: int = 4) -> list[T]:
    """Results of ``tasks`` in order; up to ``at_once`` of them submit their jobs at the same time.

    For independent work in many small jobs, whose latency would add up. Each thread inherits the caller's local
    properties. The first error is raised when all have ended; nested calls run one after another.
    """
    if at_once < 2 or len(tasks) < 2 or getattr(_inside, "pool", False):
        return [task() for task in tasks]

    def run(task: Callable[[], T]) -> T:
        _inside.pool = True
        return task()

    with ThreadPoolExecutor(min(at_once, len(tasks))) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(run), task) for task in tasks]
    return [w.result() for w in waiting]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session, from ``spark.checkpoint.dir``.

    A private folder is made only for a local master; on a cluster a missing
    setting is an error, because a machine-local folder dies with its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="rankloom-ckpt-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def drop_stage(df) -> None:
    """Remove the files of a frame from ``stage_table`` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getParent().getName() == "stages":
            folder.getFileSystem(hadoop).delete(folder, True)


_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
_BUCKETED_SCAN = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_switch_lock = threading.Lock()
_switch_users: dict[tuple[str, str], tuple[int, str]] = {}


@contextmanager
def _switched(spark: SparkSession, setting: str, to: str):
    """The setting is put back when the last thread of the application has left."""
    key = spark.sparkContext.applicationId, setting
    with _switch_lock:
        n, old = _switch_users.get(key, (0, ""))
        old = old or spark.conf.get(setting, "true" if to == "false" else "false")
        _switch_users[key] = n + 1, old
        spark.conf.set(setting, to)
    try:
        yield
    finally:
        with _switch_lock:
            n, old = _switch_users.pop(key)
            if n > 1:
                _switch_users[key] = n - 1, old
            else:
                spark.conf.set(setting, old)


def frees_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a write go when it ends, not when the driver happens to collect its garbage."""
    return _switched(spark, _SHUFFLE_CLEANUP, "true")


def cut_lineage(df):
    """Write ``df`` to the checkpoint folder and return it with a fresh plan."""
    ensure_checkpoint_dir(df.sparkSession)
    with frees_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame keeps the setting it was made under


def stage_folder(spark: SparkSession, name: str) -> str:
    """A folder for a named stage table beside the checkpoints."""
    return os.path.join(ensure_checkpoint_dir(spark), "stages", name)


def stage_table(df, name: str):
    """Write ``df`` as parquet in the shared folder and read it back.

    For wide frames: unlike a checkpoint, a later plan reads only the columns it needs.
    """
    path = stage_folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    with frees_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def joins_in_buckets(spark: SparkSession):
    """Inside, joins on (search, hotel) of tables in equal buckets of searches are not shuffled."""
    return _switched(spark, _CO_PARTITION, "false")


def scans_in_buckets(spark: SparkSession):
    """Inside, a table in buckets is read bucket by bucket, also where the plan does not gain by it: learners draw by place."""
    return _switched(spark, _BUCKETED_SCAN, "false")


#: Rows to one bucket of a staged table, so that a task's windows stay small however large the table.
BUCKET_ROWS = 250_000


def bucket_number(rows: int, least: int) -> int:
    """Buckets for a table of ``rows`` rows; their number grows with the rows, not their size."""
    return max(least, -(-rows // BUCKET_ROWS))


def stage_buckets(df, name: str, keys: Sequence[str], n: int, apart: Sequence[str] = ()):
    """Like ``stage_table``, dealt by ``keys`` into ``n`` buckets; a filter on a column in ``apart`` reads its own files only.

    Windows, groups and joins by ``keys`` then need no shuffle; a checkpoint does not keep its partitioning when the
    plan is adaptive. The files lie in the shared folder; the catalog knows the table by a name of its own.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(n, *keys)  # Spark leaves it out where the rows already lie so
    with frees_shuffles(spark):
        writer = dealt.write.format("parquet").partitionBy(*apart) if apart else dealt.write.format("parquet")
        writer.bucketBy(n, *keys).sortBy(*keys).option("path", stage_folder(spark, table)).saveAsTable(table)
    return spark.table(table)
