"""Session helpers: shared folder for cut lineage, size checks, salting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def session(spark: SparkSession | None = None) -> SparkSession:
    """The given session, else the active one, else a new one with the defaults."""
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the one set on the context.

    Only in local mode, where driver and executors are one process, a temporary folder is
    made if neither is set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tallyforge-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(made)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Rows per shuffle partition and settings of a packed stash.
PACKED_ROWS = 50_000
PACKED = {
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
}


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]):
    """Session settings for a while; what they were before comes back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Stash:
    """Tables written once into the shared folder: they cut lineage and survive lost executors.

    ``put`` returns the table read back and its row count. The count is taken by the writing
    (result) stage, whose updates Spark applies once per partition however often a task
    is tried. ``drop`` deletes a table that is no longer needed; the rest goes when the JVM ends.
    ``packed`` is for iterations, whose rounds are often tiny and then cost little but tasks and files: a
    write may join shuffle partitions up to 4 MB, also below the number of cores, and shuffles are as wide
    as the largest table put so far asks for (``PACKED_ROWS`` a partition), at least one partition a core.
    """

    def __init__(self, spark: SparkSession, packed: bool = False):
        self.spark, self.packed = spark, packed
        self.base = f"{shared_folder(spark)}/tallyforge-{uuid.uuid4().hex}"
        self.files = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.deleteOnExit(self._path(self.base))
        self.number, self.most = 0, 0
        self.kept: dict[str, DataFrame] = {}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def put(self, frame: DataFrame) -> tuple[DataFrame, int]:
        self.number += 1
        name = f"{self.base}/{self.number}"
        seen = Observation()
        with configured(self.spark, self._settings()):
            frame.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(name)
        back = self.spark.read.schema(frame.schema).parquet(name)
        self.kept[name] = back
        n = int(seen.get["n"])
        self.most = max(self.most, n)
        return back, n

    def _settings(self) -> dict[str, str]:
        if not self.packed:
            return {}
        if not self.most:
            return PACKED
        width = max(self.spark.sparkContext.defaultParallelism, -(-self.most // PACKED_ROWS))
        return {**PACKED, "spark.sql.shuffle.partitions": str(width)}

    def _name(self, frame: DataFrame) -> str | None:
        return next((name for name, kept in self.kept.items() if kept is frame), None)

    def together(self, frames: list[DataFrame]) -> DataFrame:
        """Tables of one schema, written by ``put``, as a single scan."""
        return self.spark.read.schema(frames[0].schema).parquet(*[self._name(f) for f in frames])

    def drop(self, frame: DataFrame) -> None:
        if name := self._name(frame):
            del self.kept[name]
            self.files.delete(self._path(name), True)


#: A key with more than this share of the left rows (and more rows than ``HOT_ROWS``) is cut into chunks.
HOT_PARTS, HOT_ROWS = 2000, 100_000


def join_spread(
    left: DataFrame, right: DataFrame, key: str, how: str, by: Sequence[str], counted: DataFrame | None = None
) -> DataFrame:
    """Equi-join on ``key`` in which no left key fills a task: ``inner``, ``left``, ``left_semi`` or ``left_anti``.

    Left keys are counted first (combined before the shuffle), in ``left`` or in a cheaper frame
    ``counted`` that holds each key at least as often. The rows of a key that holds more
    than ``1/HOT_PARTS`` of them are cut by a hash of ``by`` into chunks of about that
    size, and the right rows of that key are repeated for each chunk. There are fewer than ``HOT_PARTS`` such keys, so
    their list is broadcast. Without one it is a plain join; the result is the same. Null keys meet nothing.
    Columns other than the key must differ in name.
    """
    sizes = (left if counted is None else counted).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    seen = sizes.agg(F.sum("__n").alias("total"), F.max("__n").alias("most")).first()
    limit = max((seen["total"] or 0) // HOT_PARTS, HOT_ROWS)
    if (seen["most"] or 0) <= limit:
        return left.join(right, key, how)
    hot = F.broadcast(sizes.filter(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__chunks")))
    chunks = F.coalesce("__chunks", F.lit(1))
    cut = F.when(F.col(key).isNull(), HOT_PARTS).otherwise(chunks)
    own = left.join(hot, key, "left").withColumn("__chunk", F.pmod(F.xxhash64(*by), cut).cast("int")).drop("__chunks")
    met = right.join(hot, key, "left").withColumn("__chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("__chunks")
    return own.join(met, [key, "__chunk"], how).drop("__chunk")


def lit_null(type_: str) -> Column:
    return F.lit(None).cast(type_)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan over at least as many partitions as there are cores, for heavy work per row.

    Only where a few small files make fewer partitions are rows shuffled; large inputs stay as read.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on keys that may be null; the left side's keys are kept once.

    Catalyst turns ``<=>`` into a hash- or sort-merge join. Right key columns are
    renamed first, so two frames with a common origin cannot be mixed up.
    """
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"__right_{k}") for k in keys],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"`{key}`").eqNullSafe(F.col(f"`__right_{key}`"))
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__right_{k}" for k in keys])
