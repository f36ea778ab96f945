"""Data constraints that Spark does not enforce: keys, NOT NULL, domains, references."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendwell.operators.detect import orphan_values
from mendwell.session import cut_lineage, is_small
from mendwell.spec import Dataset

_VIOLATIONS = "table string, constraint string, violations bigint"


def _union(parts: list[DataFrame], dataset: Dataset) -> DataFrame:
    if not parts:
        return next(iter(dataset.values())).sparkSession.createDataFrame([], _VIOLATIONS)
    return reduce(DataFrame.unionByName, parts)


def _maybe_alike(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows among which all are that share their key with another row.

    Of a key that is text or has several columns only a 64-bit hash is shuffled. Rows whose hash is there once
    have a key of their own; what is left is few, and the keys themselves decide. Where much is left, all rows are returned.
    """
    if len(keys) == 1 and not isinstance(df.schema[keys[0]].dataType, T.StringType):
        return df
    hashed = df.select(*keys, F.xxhash64(*keys).alias("_hash"))
    shared = cut_lineage(hashed.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash"))
    return hashed.join(F.broadcast(shared), "_hash", "left_semi") if is_small(shared) else df


def constraint_violations(dataset: Dataset) -> DataFrame:
    """Violations per table and constraint; a satisfied constraint shows 0.

    Row-local constraints of a table are counted in one scan. Rows beyond the
    first of each key violate its uniqueness.
    """
    parts = []
    for name in sorted(dataset):
        spec = dataset.specs.get(name)
        if spec is None:
            continue
        df = dataset[name]
        flags = {}
        if spec.primary_key:
            missing = reduce(lambda one, other: one | other, [F.col(key).isNull() for key in spec.primary_key])
            flags["key is not null"] = missing
        flags.update({f"not null {column}": F.col(column).isNull() for column in spec.not_null})
        flags.update({f"check {label}": ~F.expr(predicate) for label, predicate in spec.checks.items()})
        if flags:
            counts = df.agg(*[F.count_if(flag).alias(label) for label, flag in flags.items()])
            parts.append(counts.select(F.inline(F.array(*[
                F.struct(F.lit(name).alias("table"), F.lit(label).alias("constraint"), F.col(f"`{label}`").alias("violations"))
                for label in flags
            ]))))
        if spec.primary_key:
            groups = _maybe_alike(df, spec.primary_key).groupBy(*spec.primary_key).agg(F.count("*").alias("_n"))
            parts.append(groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations")).select(
                F.lit(name).alias("table"), F.lit("key is unique").alias("constraint"), "violations"
            ))
    return _union(parts, dataset)


def reference_violations(dataset: Dataset) -> DataFrame:
    """Rows per foreign key that refer to a parent that does not exist."""
    parts = []
    for name in sorted(dataset):
        spec = dataset.specs.get(name)
        for fk in spec.foreign_keys if spec else ():
            lost = orphan_values(dataset[name], fk.columns, dataset[fk.parent], fk.parent_columns)
            label = f"reference {', '.join(fk.columns)} -> {fk.parent}"
            parts.append(lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
                F.lit(name).alias("table"), F.lit(label).alias("constraint"), "violations"
            ))
    return _union(parts, dataset)


def key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows_with_key")).filter("rows_with_key > 1")
