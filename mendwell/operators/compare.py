"""Fingerprint tables and compare datasets: whole, by schema, by row and cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.functions.text import canonical_columns, row_text
from mendwell.session import cut_lineage, small_side
from mendwell.spec import Dataset

# Hex digits of a row hash that fit a signed 64-bit integer, and how many such parts are summed, each in pieces of so many bits.
_DIGEST_DIGITS, _PARTS = 15, 4
_PIECE_BITS, _PIECES = 20, 3


def row_hashes(df: DataFrame) -> DataFrame:
    return df.select(F.sha2(row_text(df), 256).alias("row_hash"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and a ``fingerprint`` that no file layout or row order
    can change.

    Row hashes are summed in parts of 60 bits, so it is one aggregate without a
    sort. Pieces of 20 bits are summed as 64-bit integers, exact for 8 * 10^12 rows, and put together at the end.
    """
    parts = [
        F.conv(F.substring("row_hash", 1 + _DIGEST_DIGITS * no, _DIGEST_DIGITS), 16, 10).cast("bigint").alias(f"h{no}")
        for no in range(_PARTS)
    ]
    mask = (1 << _PIECE_BITS) - 1
    pieces = [
        F.coalesce(F.sum(F.shiftright(f"h{no}", _PIECE_BITS * piece).bitwiseAND(F.lit(mask).cast("bigint"))), F.lit(0)).alias(f"h{no}_{piece}")
        for no in range(_PARTS) for piece in range(_PIECES)
    ]
    sums = row_hashes(df).select(*parts).agg(F.count("*").alias("rows"), *pieces)

    def whole(no: int) -> Column:
        total = F.lit(0).cast("decimal(38,0)")
        for piece in reversed(range(_PIECES)):
            total = (total * F.lit(1 << _PIECE_BITS).cast("decimal(8,0)")).cast("decimal(38,0)") + F.col(f"h{no}_{piece}").cast("decimal(19,0)")
        return total.cast("decimal(38,0)").cast("string")

    return sums.select("rows", F.concat_ws(":", F.col("rows").cast("string"), *[whole(no) for no in range(_PARTS)]).alias("fingerprint"))


def fingerprints(dataset: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        fingerprint(dataset[name]).select(F.lit(name).alias("table"), "rows", "fingerprint") for name in sorted(dataset)
    ])


def compare_prints(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two lists of fingerprints side by side, with ``match`` per table."""
    one = left.select("table", F.col("rows").alias("left_rows"), F.col("fingerprint").alias("left_fingerprint"))
    other = right.select("table", F.col("rows").alias("right_rows"), F.col("fingerprint").alias("right_fingerprint"))
    same = (F.col("left_rows") == F.col("right_rows")) & (F.col("left_fingerprint") == F.col("right_fingerprint"))
    return one.join(other, "table", "full_outer").withColumn("match", F.coalesce(same, F.lit(False)))


def compare_datasets(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame]) -> DataFrame:
    return compare_prints(fingerprints(left), fingerprints(right))


def logical_match(comparison: DataFrame) -> DataFrame:
    """One row: do all tables match, and how many."""
    return comparison.agg(
        F.every("match").alias("logical_match"),
        F.count_if("match").alias("matching_tables"),
        F.count("*").alias("table_count"),
    )


def meets_expectations(dataset: Mapping[str, DataFrame], expectations: DataFrame) -> DataFrame:
    """Tables against stored row counts and fingerprints, without a baseline."""
    return compare_prints(fingerprints(dataset), expectations)


def check_input(dataset: Mapping[str, DataFrame], expectations: DataFrame) -> None:
    """Refuse an input that the labels were not made for."""
    wrong = meets_expectations(dataset, expectations).filter("not match").select("table").first()
    if wrong is not None:
        raise ValueError(f"table {wrong['table']!r} is not the one the labels were made for")


def _columns(dataset: Dataset) -> list[tuple]:
    rows = []
    for name in sorted(dataset):
        spec = dataset.specs.get(name)
        for place, field in enumerate(dataset[name].schema.fields):
            key = spec.primary_key.index(field.name) + 1 if spec and field.name in spec.primary_key else 0
            rows.append((name, field.name, place, field.dataType.simpleString(), key))
    return rows


def compare_schemas(left: Dataset, right: Dataset) -> DataFrame:
    """Columns that differ in presence, place, type or place in the key."""
    spark = next(iter(left.values())).sparkSession
    shape = "table string, column string, place int, type string, key_place int"
    frames = []
    for side, dataset in (("left", left), ("right", right)):
        frame = spark.createDataFrame(_columns(dataset), shape)
        frames.append(frame.select("table", "column", *[F.col(c).alias(f"{side}_{c}") for c in ("place", "type", "key_place")]))
    joined = frames[0].join(frames[1], ["table", "column"], "full_outer")
    same = reduce(lambda one, other: one & other, [
        F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in ("place", "type", "key_place")
    ])
    return joined.filter(~same)


BUCKETS = 4096


def _bucketed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the bucket of their key on two levels and 128 bits of their content."""
    key, content = F.xxhash64(*keys), row_text(df)
    return df.withColumns({
        "_b1": F.pmod(key, F.lit(BUCKETS)), "_b2": F.pmod(F.shiftright(key, 32), F.lit(BUCKETS)),
        "_h1": F.xxhash64(F.lit(1), content), "_h2": F.xxhash64(F.lit(2), content),
    })


def _different(left: DataFrame, right: DataFrame, level: Sequence[str]) -> DataFrame:
    """Buckets whose digests differ: a row of sums for each bucket, merged before it moves."""
    def digests(df: DataFrame) -> DataFrame:
        return df.groupBy(*level).agg(
            F.count("*").alias("n"), F.sum(F.col("_h1").cast("decimal(20,0)")).alias("sum"), F.bit_xor("_h2").alias("xor"))

    both = digests(left).withColumn("_side", F.lit(1)).unionByName(digests(right).withColumn("_side", F.lit(2)))
    sides = both.groupBy(*level).agg(F.count("*").alias("sides"), F.countDistinct("n", "sum", "xor").alias("kinds"))
    return sides.filter((F.col("sides") < 2) | (F.col("kinds") > 1)).select(*level)


def changed_buckets(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables that share a bucket with a difference; all others are equal and stay where they are.

    A tree of digests in two levels: sums of row hashes in a few thousand buckets of the
    key, then, inside those that differ, in as many again. Equal tables cost one scan each and no
    shuffle of rows; a changed row makes the comparison read its bucket.
    """
    sides = [_bucketed(df, keys) for df in (left, right)]
    for level in (["_b1"], ["_b1", "_b2"]):
        wrong = small_side(cut_lineage(_different(*sides, level)))
        sides = [side.join(wrong, level, "left_semi") for side in sides]
    return sides[0].select(*left.columns), sides[1].select(*right.columns)


def row_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose row was added, removed or changed."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.sha2(row_text(df), 256).alias(name))

    left, right = changed_buckets(left, right, keys)
    joined = side(left, "_left").join(side(right, "_right"), list(keys), "full_outer")
    change = (
        F.when(F.col("_left").isNull(), "added").when(F.col("_right").isNull(), "removed").otherwise("changed")
    )
    return joined.filter(~F.col("_left").eqNullSafe(F.col("_right"))).select(*keys, change.alias("change"))


def cell_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells that differ: key, column, both values and the kind of change.

    Whole rows that were added or removed appear once, with a NULL column.
    """
    values = [name for name in left.columns if name not in keys and name in right.columns]

    def side(df: DataFrame, name: str) -> DataFrame:
        cells = canonical_columns(df, values)
        empty = F.lit(0).alias("_there")
        return df.select(*keys, F.struct(empty, *cells).alias(name))

    left, right = changed_buckets(*(df.select(*dict.fromkeys([*keys, *values])) for df in (left, right)), keys)
    joined = side(left, "_l").join(side(right, "_r"), list(keys), "full_outer").filter(
        ~F.col("_l").eqNullSafe(F.col("_r"))
    )
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("column"), F.col(f"_l.{name}").alias("left_value"), F.col(f"_r.{name}").alias("right_value")
        )
        for name in values
    ])
    nothing = F.lit(None).cast("string")
    whole = F.array(F.struct(nothing.alias("column"), nothing.alias("left_value"), nothing.alias("right_value")))
    changed = F.filter(cells, lambda cell: ~cell["left_value"].eqNullSafe(cell["right_value"]))
    return joined.select(
        *keys,
        F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").otherwise("changed").alias("change"),
        F.explode(F.when(both, changed).otherwise(whole)).alias("_c"),
    ).select(*keys, "change", "_c.column", "_c.left_value", "_c.right_value")
