"""Cutting lineage through shared storage, and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"

# A side is broadcast only when it holds at most this many narrow rows
# (key, value and a few words of evidence: some tens of megabytes).
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 256 << 20

_own_folders: set[str] = set()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for tables in between: the one that the cluster names,
    else one in the warehouse, which driver and executors share as well."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get(CHECKPOINT_CONF, None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_mendwell"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written in between, in a folder of this
    application that goes when the driver ends."""
    root = f"{checkpoint_folder(spark).rstrip('/')}/mendwell-{spark.sparkContext.applicationId}"
    if root not in _own_folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(root)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(place)
        system.deleteOnExit(place)
        _own_folders.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read on from there.

    Unlike a checkpointed RDD the written table is computed once, and later
    plans still prune its columns and push their filters into its scan.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_all(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """``cut_lineage`` of several tables side by side."""
    with ThreadPoolExecutor(max_workers=max(len(tables), 1)) as pool:
        return dict(zip(tables, pool.map(cut_lineage, tables.values())))


def _row_bytes(df: DataFrame) -> Column:
    """About how much a row of ``df`` takes."""
    total = F.lit(0)
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value) if isinstance(field.dataType, T.StructType) else F.to_json(F.struct(value))
        own = F.octet_length(value) if not isinstance(field.dataType, T.AtomicType) or isinstance(
            field.dataType, (T.StringType, T.BinaryType)) else F.lit(8)
        total = total + F.coalesce(own, F.lit(0))
    return total.cast("long")


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df`` may be broadcast by its rows and its bytes; it is read up to ``limit + 1`` rows."""
    limit = BROADCAST_ROWS if limit is None else limit
    found = df.limit(limit + 1).select(_row_bytes(df).alias("size")).agg(F.count("*"), F.sum("size")).first()
    return found[0] <= limit and (found[1] or 0) <= BROADCAST_BYTES


def small_side(df: DataFrame, rows: int | None = None, limit: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if it is known or found to be small.

    ``rows`` is an upper bound the caller can prove, for narrow rows. Without one
    rows and bytes are measured. Beyond the limit the join is told to shuffle: the planner
    goes by sizes on disk, where keys take a tenth of what they take in the driver's memory.
    """
    small = is_small(df, limit) if rows is None else rows <= (BROADCAST_ROWS if limit is None else limit)
    return F.broadcast(df) if small else df.hint("merge")


# A set of keys as bits: so many a key, in words of 64, of which at most so many (32 MB), and words a row. A key sets so many bits of its word.
KEY_BITS, KEY_WORDS, ROW_WORDS, KEY_MARKS = 16, 1 << 22, 512, 4


def split_by(df: DataFrame, on: Sequence[str], keys: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key may be among ``keys``, and all others, whose key is not.

    Each of the about ``rows`` keys sets four bits of a word, and the bits alone are broadcast. Some one in a hundred rows
    without a key there finds its bits set by others, more where the set is as large as it may get.
    """
    most = min(rows * KEY_BITS // 64 + 1, KEY_WORDS)
    words = -(-most // ROW_WORDS) * ROW_WORDS
    hashed = F.xxhash64(*on)
    word = F.pmod(hashed, F.lit(words).cast("bigint"))
    one = F.lit(1).cast("bigint")
    bit = reduce(Column.bitwiseOR, [
        F.call_function("shiftleft", one, F.shiftrightunsigned(hashed, 58 - 6 * no).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
        for no in range(KEY_MARKS)
    ])
    none = df.sparkSession.range(words).select(F.col("id").alias("_word"), F.lit(0).cast("bigint").alias("_bits"))
    made = none.unionByName(keys.select(word.alias("_word"), bit.alias("_bits"))).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    place = F.floor(F.col("_word") / ROW_WORDS).cast("int")
    sets = cut_lineage(made.groupBy(place.alias("_place")).agg(
        F.array_sort(F.collect_list(F.struct("_word", "_bits")))["_bits"].alias("_set")))
    found = F.col("_set")[(word % ROW_WORDS).cast("int")].bitwiseAND(bit) == bit
    marked = df.join(F.broadcast(sets), F.floor(word / ROW_WORDS).cast("int") == F.col("_place"), "left").withColumn(
        "_near", F.coalesce(found, F.lit(False)))
    return marked.filter("_near").select(*df.columns), marked.filter("NOT _near").select(*df.columns)


def meet(
    df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left", rows: int | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """Join ``df`` (``left``, ``left_semi`` or ``left_anti``) with the few keys of ``side``, so that the rest of ``df`` stays where it is.

    A small side (see ``small_side``) is broadcast. For a larger one only those rows are shuffled that
    may find their key there. ``keys`` has the same keys as ``side``, if these are easier to get.
    """
    on = list(on)
    if is_small(side) if rows is None else rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(side), on, how)
    keys = (side if keys is None else keys).select(*on)
    near, far = split_by(df, on, keys, keys.count() if rows is None else rows)
    met = near.join(side.hint("merge"), on, how)
    return met if how == "left_semi" else met.unionByName(far, allowMissingColumns=True)
