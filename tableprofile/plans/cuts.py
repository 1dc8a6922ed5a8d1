"""Places where a plan is cut: reliable checkpoints, row ids, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DatetimeType, NumericType, StringType

from tableprofile.functions.columns import quoted

# Rows of a few numbers each: about 100 MB in the broadcast hash table at most.
BROADCAST_ROWS = 1_000_000


def _checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_folder(spark: SparkSession, name: str = "") -> str:
    """A new path in the checkpoint folder, deleted when the session ends."""
    _checkpoint_dir(spark)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return f"{folder.toString()}/{name}" if name else folder.toString()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and read them back from there.

    Used where a result feeds several later jobs, or must not change when it is computed again.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_open = threading.local()       # scopes: a list of folders for each `passing` that is open in this thread


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` makes inside are deleted at the end, but for those that outlive it; the disk of shuffles too.

    Nothing that is still to be computed may read the deleted ones.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for folder in scopes.pop():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles whose query has ended: it does so when the driver's garbage is collected, which may
    be much later, as the driver makes little of it."""
    spark._jvm.System.gc()


def written(df: DataFrame, outlives: bool = False, compression: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder, deleted when the session ends, or the innermost open `passing`
    does; with outlives, the one around that.

    A lost executor costs no more than a new read; nothing before the table is computed again.
    """
    spark = df.sparkSession
    _checkpoint_dir(spark)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}")
    scopes = getattr(_open, "scopes", [])
    if len(scopes) > outlives:
        scopes[-1 - outlives].append(folder)
    df.write.option("compression", compression).parquet(folder.toString())
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    table = spark.read.schema(df.schema).parquet(folder.toString())
    table.written_to = folder
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that `written` or `packed` returned, before its time."""
    if folder := getattr(table, "written_to", None):
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def packed(df: DataFrame, outlives: bool = False) -> DataFrame:
    """Like `written`, in a fifth of the space that a checkpoint takes; what Parquet doesn't hold is a checkpoint."""
    plain = all(isinstance(f.dataType, (NumericType, BooleanType, StringType, BinaryType, DatetimeType)) for f in df.schema)
    return written(df, outlives, "zstd") if plain and len(set(map(str.lower, df.columns))) == len(df.columns) else cut(df)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add a generated id for tables without a key. Materialised, because the generated
    numbers may differ when a lost partition is computed again."""
    return packed(df.withColumn(name, F.monotonically_increasing_id()))


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it is counted to have at most `limit` rows; else leave the join
    to a shuffle. Call it on checkpointed or tiny inputs, so that the count is cheap."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by key on the session's number of shuffle partitions. For work that is dear per row: a number that is
    given is not folded by bytes, which would leave cores idle where groups are small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def hot_split_join(rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str, total: int,
                   hot_share: int = 1000) -> DataFrame:
    """Inner join of rows with one row per key, where a key may own a large part of the rows.

    Keys with more than total/hot_share rows number less than hot_share, so they are always
    small enough to broadcast; their rows never move. The rest is an ordinary equi-join in
    which no key is hot.
    """
    bound = total // hot_share
    hot = F.broadcast(per_key.where(F.col(weight) > bound))
    marked = rows.join(hot.select(*keys, F.lit(True).alias("__hot")), keys, "left")
    return rows.join(hot, keys).unionByName(
        marked.where(F.col("__hot").isNull()).drop("__hot").join(per_key.where(F.col(weight) <= bound), keys))


def id_column(df: DataFrame, row_id: str):
    return quoted(row_id).alias("row_id")
