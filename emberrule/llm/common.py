"""Helpers shared by the corpus operators: shared storage, salted attachment, distributed ranks."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a summary table (one row a source, a partition, ...) may be broadcast.
BROADCAST_ROWS = 20_000
#: Pieces at least into which the rows of one key are dealt where a key may be hot.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


_folders: dict[str, SparkSession] = {}  # written and not removed yet, in order


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, the session's own checkpoint folder takes its
    place, and in a local session, which is one machine, a new temporary one. Other sessions must have it set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="emberrule-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/emberrule-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(release)
    _folders[path] = spark
    return path


def written() -> int:
    """How many folders of intermediate results there are."""
    return len(_folders)


def release(since: int = 0, but_last: int = 0) -> None:
    """Remove the folders of intermediate results from the ``since``th on, but the last few. Nothing may read them any more."""
    for path in list(_folders)[since : len(_folders) - but_last]:
        _remove(_folders.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; its cluster clears the folder
        pass


def free_plans(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer held."""
    gc.collect()
    time.sleep(1.5)  # the gateway tells the JVM once a second what Python has let go
    with suppress(Py4JJavaError):  # listeners that are behind still hold plans: after a while they may keep them
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.sparkContext._jvm.System.gc()


def hash_sample(df: DataFrame, hash_: Column, n: int, most: int) -> DataFrame:
    """About ``most`` rows, and hardly ever more, of ``n`` whose hashes differ: those below an edge. No rows are ranked."""
    if n <= most:
        return df
    share = max(0.0, most - 4 * most**0.5) / n
    return df.filter(hash_ < F.lit(-(2**63) + int(share * 2**64)))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: lineage ends, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What is written meanwhile reaches Python in batches of about ``size``, so that workers hold little of long texts."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def salt(seed: str | Column, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), seed), F.lit(n)).cast("int")


def attach_small(rows: DataFrame, summary: DataFrame, key: str, seed: str, n_summary: int) -> DataFrame:
    """Join a one-row-a-key ``summary`` to ``rows`` on ``key``, nulls matching.

    A summary of at most ``BROADCAST_ROWS`` rows (counted by the caller) is broadcast; a larger one is
    repeated once a salt, and the rows of a hot key are dealt over the salts.
    """
    right = summary.withColumnRenamed(key, "__key")
    if n_summary <= BROADCAST_ROWS:
        return rows.join(F.broadcast(right), rows[key].eqNullSafe(right["__key"]), "left").drop("__key")
    left = rows.withColumn("__salt", salt(seed))
    right = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = left[key].eqNullSafe(right["__key"]) & (left["__salt"] == right["__s"])
    return left.join(right, on, "left").drop("__key", "__salt", "__s")


def attach_keyed(rows: DataFrame, summary: DataFrame, key: str, seed: str) -> DataFrame:
    """Join a one-row-a-key ``summary`` of any size to ``rows`` on ``key``, which isn't null, dealing the rows of a key over salts.

    The summary's rows are repeated only for the salts that a key has.
    """
    salted = rows.withColumn("__salt", salt(seed))
    wide = salted.select(key, "__salt").distinct().join(summary, key)
    return salted.join(wide, [key, "__salt"], "left").drop("__salt")


def attach_group(rows: DataFrame, keys: list[str], seed: str, partial: list[Column], final: list[Column]) -> DataFrame:
    """Give each row aggregates of its group, though one group may hold a third of all rows.

    Groups are first summed by (keys, salt) with ``partial``, then by keys with ``final`` over the partial
    columns. A group's result goes back once to each of its salts, so that no task gets a whole group.
    """
    pieces = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("__salt", salt(seed, pieces))
    parts = salted.groupBy(*keys, "__salt").agg(*partial)
    whole = parts.groupBy(*keys).agg(*final, F.collect_list("__salt").alias("__salts"))
    back = whole.withColumn("__salt", F.explode("__salts")).drop("__salts")
    for k in keys:
        back = back.withColumnRenamed(k, f"__k_{k}")
    back = back.withColumnRenamed("__salt", "__s")
    on = salted["__salt"] == back["__s"]
    for k in keys:
        on = on & salted[k].eqNullSafe(back[f"__k_{k}"])
    return salted.join(back, on).drop("__salt", "__s", *(f"__k_{k}" for k in keys))


def ranked(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: its rows' number from 0 in a total order, counted by ranges and not in one task."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return (
        dealt.join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__before") + number).cast("long"))
        .drop("__part", "__before")
    )


def text_hash(kind: str = "sha2") -> Column:
    """A hash of a row's text as given, by which, with its id, the row can be found again."""
    return F.sha2(text_of("text"), 256) if kind == "sha2" else F.xxhash64(text_of("text"))


def give_back(docs: DataFrame, verdicts: DataFrame, value: str, hash_col: str, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``__row``, a row of ``docs`` whole, and as ``__value`` its number ``value`` of ``verdicts`` (a row for each row of docs; ``by`` and ``hash_col``).

    Columns of docs may have any names, since they travel as one. Rows that agree in ``by`` and their text get the numbers of that key in turn, whichever row gets which. Rows whose
    numbers are all 0 are left out, so that their texts need not be kept.
    """
    kind = "sha2" if dict(verdicts.dtypes)[hash_col] == "string" else "xxhash64"
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)] + [F.col(hash_col).alias("__kh"), F.col(value).cast("long").alias("__v")]
    names = [f"__k{i}" for i in range(len(by))] + ["__kh"]
    numbers = verdicts.select(*keys).groupBy(*names).agg(F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__sum"), F.max("__v").alias("__value"))
    mixed = not numbers.filter("__sum <> __n * __value").isEmpty()
    wanted = numbers.filter("__sum > 0").drop("__n", "__sum")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), text_hash(kind).alias("__h"))
    on = F.col("__h") == F.col("__kh")
    for i, k in enumerate(by):
        on = on & F.col(f"__row.{k}").eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(wanted, on)
    if mixed:  # rows of one key with different numbers: repeated rows
        lists = verdicts.select(*keys).groupBy(*names).agg(F.sort_array(F.collect_list("__v"), False).alias("__list"))
        nth = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
        lists = lists.select(*(F.col(n).alias(f"{n}l") for n in names), "__list")
        on = F.col("__kh") == F.col("__khl")
        for i in range(len(by)):
            on = on & F.col(f"__k{i}").eqNullSafe(F.col(f"__k{i}l"))
        out = out.withColumn("__nth", nth).join(lists, on).withColumn("__value", F.get("__list", F.col("__nth") - 1)).filter("__value > 0")
    return out.select("__row", "__value")
