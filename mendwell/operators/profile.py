"""Profile of tables: rows, NULLs, distinct values, storage classes, schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendwell.functions.text import canonical_value, storage_class
from mendwell.operators.compare import fingerprint
from mendwell.operators.constraints import constraint_violations, reference_violations
from mendwell.spec import Dataset, Rule, TableSpec

METRICS = "table string, column string, metric string, value string"


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(dataset: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, in order of table names."""
    return _union(
        dataset[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name in sorted(dataset)
    ).orderBy("table")


def null_counts(df: DataFrame) -> DataFrame:
    """NULLs per column, all columns in one pass."""
    counts = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in df.columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(name).alias("null_count")) for name in df.columns
    ])))


_LONG = 64
BITMAP_RANGE = 1 << 22  # at most 128 bitmaps of 4 kB a task


def _plain_columns(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    types = {field.name: field.dataType for field in df.schema.fields}
    return [canonical_value(F.col(name), types[name]) for name in columns]


def _whole_number(name: str, dtype: T.DataType) -> Column | None:
    """Integers and dates as 64-bit integers."""
    if isinstance(dtype, T.DateType):
        return F.unix_date(name).cast("bigint")
    return F.col(name).cast("bigint") if isinstance(dtype, T.IntegralType) else None


def _distinct_values(df: DataFrame, name: str, dtype: T.DataType) -> DataFrame:
    """The values of a column in its own type; a long text is known by its hash, which is all that travels."""
    value = F.col(name)
    if isinstance(dtype, T.StringType):
        value = F.when(F.length(value) > _LONG, F.concat(F.lit("sha256:"), F.sha2(value, 256))).otherwise(value)
    elif not isinstance(dtype, T.AtomicType):
        value = canonical_value(value, dtype)
    return df.select(value.alias("value")).filter(F.col("value").isNotNull()).distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Distinct values per column; NULL is not a value.

    Each column is read by itself and in its own type. Integers and dates of a range below
    ``BITMAP_RANGE`` are marked in bitmaps, which are merged in place of values; all else is grouped before
    it moves, so that a task sends a value once.
    """
    if not exact:
        counts = df.agg(*[F.approx_count_distinct(name).alias(name) for name in columns])
        return counts.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("column"), F.col(name).alias("distinct_count")) for name in columns
        ])))
    types = {field.name: field.dataType for field in df.schema.fields}
    whole = {name: number for name in columns if (number := _whole_number(name, types[name])) is not None}
    ends = df.agg(*[
        end(number).alias(f"{place}{label}") for place, number in enumerate(whole.values()) for label, end in (("l", F.min), ("h", F.max))
    ]).first() if whole else None
    parts = []
    for name in columns:
        place = list(whole).index(name) if name in whole else None
        low, high = (None, None) if place is None else (ends[f"{place}l"], ends[f"{place}h"])
        if low is not None and high - low < BITMAP_RANGE:
            bit = whole[name] - low + 1
            maps = df.select(bit.alias("bit")).filter(F.col("bit").isNotNull()).groupBy(
                F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
            count = maps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("distinct_count"))
        else:
            count = _distinct_values(df, name, types[name]).agg(F.count("*").alias("distinct_count"))
        parts.append(count.select(F.lit(name).alias("column"), F.col("distinct_count").cast("bigint").alias("distinct_count")))
    return _union(parts)


def storage_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Histogram of what the cells of each column hold."""
    cells = [
        F.struct(F.lit(name).alias("column"), storage_class(value).alias("storage_type"))
        for name, value in zip(columns, _plain_columns(df, columns), strict=True)
    ]
    return df.select(F.inline(F.array(*cells))).groupBy("column", "storage_type").agg(F.count("*").alias("cells"))


def schema_profile(dataset: Dataset) -> DataFrame:
    """Declared type, NOT NULL and place in the key, per column."""
    spark = next(iter(dataset.values())).sparkSession
    rows = []
    for name in sorted(dataset):
        spec = dataset.specs.get(name, TableSpec(name, ()))
        for field in dataset[name].schema.fields:
            place = spec.primary_key.index(field.name) + 1 if field.name in spec.primary_key else 0
            rows.append((name, field.name, field.dataType.simpleString(), field.name in spec.not_null, place))
    return spark.createDataFrame(rows, "table string, column string, type string, not_null boolean, key_place int")


def target_columns(rules: DataFrame) -> DataFrame:
    """Columns that rules aim at, per table, from a table of rules."""
    return (
        rules.select("table", F.explode("columns").alias("column"))
        .groupBy("table")
        .agg(F.array_sort(F.collect_set("column")).alias("columns"))
    )


def targets_of(rules: Iterable[Rule]) -> dict[str, list[str]]:
    found: dict[str, set[str]] = {}
    for rule in rules:
        found.setdefault(rule.table, set()).update(rule.columns)
    return {table: sorted(columns) for table, columns in found.items()}


def profile(dataset: Dataset, targets: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Everything about a dataset as rows of (table, column, metric, value)."""

    def long(df: DataFrame, table: str | Column, metric, column, value) -> DataFrame:
        return df.select(
            F.lit(table).alias("table"), column.cast("string").alias("column"), metric.alias("metric"),
            value.cast("string").alias("value"),
        )

    nothing = F.lit(None)
    parts = []
    for name in sorted(dataset):
        df = dataset[name]
        prints = fingerprint(df)
        parts.append(long(prints, name, F.lit("rows"), nothing, F.col("rows")))
        parts.append(long(prints, name, F.lit("fingerprint"), nothing, F.col("fingerprint")))
        parts.append(long(null_counts(df), name, F.lit("null_count"), F.col("column"), F.col("null_count")))
        columns = list((targets or {}).get(name, ()))
        if columns:
            parts.append(long(distinct_counts(df, columns), name, F.lit("distinct_count"), F.col("column"), F.col("distinct_count")))
            kind = F.concat(F.lit("storage_type:"), F.col("storage_type"))
            parts.append(long(storage_types(df, columns), name, kind, F.col("column"), F.col("cells")))
    declared = schema_profile(dataset)
    parts.append(declared.select("table", "column", F.lit("declared_type").alias("metric"), F.col("type").alias("value")))
    parts.append(long(declared.filter("not_null"), F.col("table"), F.lit("not_null"), F.col("column"), F.lit("true")))
    parts.append(long(declared.filter("key_place > 0"), F.col("table"), F.lit("key_place"), F.col("column"), F.col("key_place")))
    broken = constraint_violations(dataset).unionByName(reference_violations(dataset))
    parts.append(broken.select(
        "table", F.lit(None).cast("string").alias("column"), F.col("constraint").alias("metric"),
        F.col("violations").cast("string").alias("value"),
    ))
    return _union(parts)
