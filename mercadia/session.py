"""Spark session defaults for the marketplace jobs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes (broadcast
# only when the measured side is under the threshold), coalesces small shuffle
# partitions and splits skewed ones. The marts aggregate right after joins on
# order_id and reuse the join's partitioning; AQE only splits a skewed join
# partition there when forced, and then pays one extra shuffle of partially
# aggregated rows - only when a key is actually hot. Timestamps have no zone.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # checkpoint files of marts that are no longer referenced are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def scale_conf(input_bytes: int, partition_bytes: int = 256 << 20,
               input_per_shuffle_partition: int = 1 << 30, least: int = 200) -> dict[str, str]:
    """Settings sized for an input of ``input_bytes`` (compressed, on disk).

    File splits and the advisory shuffle partition size are
    ``partition_bytes``. Shuffles carry pruned, partially aggregated rows, far
    less than the input, so the initial shuffle width is one partition per
    ``input_per_shuffle_partition`` of input, ``least`` at the least; AQE then
    coalesces partitions that come out small.
    """
    parts = max(least, -(-input_bytes // input_per_shuffle_partition))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


#: Input (compressed, on disk) and shuffled bytes of one task: some 400,000 item rows with their orders, which take
#: about 350 MB of execution memory where rows are joined, sorted and aggregated by order in one stage.
TASK_BYTES = 8 << 20
#: Shuffle partitions that ``TASK_BYTES`` may ask for; a wider shuffle costs the driver more than it saves the tasks,
#: whose sorts and aggregates spill.
WIDEST = 20_000

WIDTH = "spark.sql.shuffle.partitions"
FIRST_WIDTH = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SKEWED = "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"
FORCE_SKEW = "spark.sql.adaptive.forceOptimizeSkewedJoin"


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([bkmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit if unit not in ("", "b") else " ")


def task_conf(spark: SparkSession, input_bytes: int, task_bytes: int = TASK_BYTES) -> dict[str, str]:
    """Settings that keep a shuffle task's memory the same at every size of the input.

    AQE joins shuffle partitions up to the advisory size or to one for each core, and splits none that
    is not skewed: with the defaults a task's rows grow with the input, and with them the sorts of a
    join and the aggregates behind it, all of which one task holds. So the width follows the input,
    and partitions come together up to ``task_bytes`` only. The session's own width and sizes stay where they are finer.
    """
    width = min(-(-input_bytes // task_bytes), max(WIDEST, -(-input_bytes // (1 << 30))))
    out = {key: str(max(width, int(spark.conf.get(key)))) for key in (WIDTH, FIRST_WIDTH) if spark.conf.get(key, None)}
    for key, most in ((ADVISORY, task_bytes), (SKEWED, 4 * task_bytes)):
        out[key] = f"{min(most, _bytes(spark.conf.get(key)))}b"
    return out | {FORCE_SKEW: "true"}


# per session: input folder -> (session sized for it, settings taken over)
_SIZED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def sized_session(spark: SparkSession, name: str, input_bytes: int) -> SparkSession:
    """A session beside ``spark``, with its present settings and :func:`task_conf` for the input called ``name``.

    Both share the cluster; the caller's settings are left alone.
    """
    memo = _SIZED.setdefault(spark, {})
    if name not in memo:
        memo[name] = (spark.newSession(), set())
    sized, taken = memo[name]
    wanted, has = dict(spark.conf.getAll) | task_conf(spark, input_bytes), sized.conf.getAll
    changed = {k: v for k, v in wanted.items() if has.get(k) != v}
    for key, value in changed.items():
        sized.conf.set(key, value)
    for key in taken - set(wanted):     # the caller has taken it back
        sized.conf.unset(key)
    memo[name] = sized, (taken & set(wanted)) | set(changed)
    return sized


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Bytes below ``paths`` as the cluster's file systems report them."""
    jvm = spark._jvm
    total = 0
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(p) or []:
            total += fs.getContentSummary(status.getPath()).getLength()
    return total


def build_session(master: str | None = None, app: str = "mercadia",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system) and a
    missing setting is an error; only a local master, as in tests, gets a scratch
    folder chosen here.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="mercadia-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder below :func:`checkpoint_dir` and read it back:
    computed once, and a lost executor costs its tasks, not the plan before."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
