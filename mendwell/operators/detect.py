"""Detectors: each returns the keys of suspect rows and the evidence.

Candidates may be wider than the truth; labels decide what is repaired.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.functions.text import key_token, row_text
from mendwell.operators.groups import found_in, lookup, with_group_stats
from mendwell.session import is_small, small_side


def suspects(df: DataFrame, keys: Sequence[str], check: Column, evidence: Sequence[str] = ()) -> DataFrame:
    """Rows a row-local check marks: a filter that reaches the scan."""
    return df.filter(check).select(*keys, *[name for name in evidence if name not in keys])


def count_suspects(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Candidates per check, all checks of a table in one scan."""
    counts = df.agg(*[F.count_if(check).alias(name) for name, check in checks.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule_id"), F.col(f"`{name}`").alias("candidates")) for name in checks])
    return counts.select(F.inline(pairs))


def duplicate_entities(
    df: DataFrame, keys: Sequence[str], business: Sequence[str], key_pattern: Column | None = None
) -> DataFrame:
    """Rows with an odd key whose business fields another row has as well.

    Fields are counted first; a field combination that occurs twice proves the
    other row, as keys are unique. NULL never equals NULL here.
    """
    odd = df if key_pattern is None else df.filter(key_pattern)
    counts = df.select(*business).na.drop("any").groupBy(*business).agg(F.count("*").alias("n")).filter("n > 1")
    found = with_group_stats(odd.select(*dict.fromkeys([*keys, *business])), counts, list(business), ["n"])
    return found.filter(F.col("n") > 1).withColumnRenamed("n", "rows_alike")


def repeated_texts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows whose fields another row has as well, for long fields.

    Fields are told apart by their SHA-256, so no text is shuffled.
    """
    known = df.na.drop("any", subset=list(columns))
    rows = known.select(*keys, F.sha2(row_text(known.select(*columns)), 256).alias("digest"))
    counts = rows.groupBy("digest").agg(F.count("*").alias("rows_alike")).filter("rows_alike > 1")
    found = with_group_stats(rows, counts, ["digest"], ["rows_alike"], "rows_alike")
    return found.filter(F.col("rows_alike").isNotNull())


def childless_duplicates(
    df: DataFrame,
    keys: Sequence[str],
    business: Sequence[str],
    child: DataFrame,
    child_keys: Sequence[str],
    key_pattern: Column | None = None,
) -> DataFrame:
    """Duplicate parents that no child row refers to."""
    alike = duplicate_entities(df, keys, business, key_pattern)
    on = [F.col(ours) == F.col(f"_child_{theirs}") for ours, theirs in zip(keys, child_keys, strict=True)]
    children = child.select(*[F.col(name).alias(f"_child_{name}") for name in child_keys])
    referred = children.join(small_side(alike.select(*keys).distinct()), on, "left_semi").distinct()
    return alike.join(referred, on, "left_anti")


def swapped_columns(df: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Rows whose two values each belong to the other column.

    A value belongs to the column where it occurs more often. Only values found
    in the wrong column come back to the rows.
    """
    words = df.select(
        F.explode(F.array(
            F.struct(F.col(left).alias("word"), F.lit(1).alias("l"), F.lit(0).alias("r")),
            F.struct(F.col(right).alias("word"), F.lit(0).alias("l"), F.lit(1).alias("r")),
        )).alias("w")
    ).select("w.*")
    counts = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    seen = counts.withColumns({"n": F.col("l") + F.col("r"), "_astray": F.lit(True)})
    not_left = found_in(seen, (F.col("r") > F.col("l")) & (F.col("l") > 0), ["_astray"])
    not_right = found_in(seen, (F.col("l") > F.col("r")) & (F.col("r") > 0), ["_astray"])
    rows = df.select(*dict.fromkeys([*keys, left, right]))
    one = with_group_stats(rows, not_left.withColumnRenamed("word", left), [left], ["_astray"])
    both = with_group_stats(
        one.filter("_astray").drop("_astray"), not_right.withColumnRenamed("word", right), [right], ["_astray"]
    ).filter("_astray")
    return both.select(*keys, left, right)


def orphans(
    child: DataFrame, keys: Sequence[str], fk: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]
) -> DataFrame:
    """Rows that refer to a parent that does not exist; a NULL reference is none.

    A small parent is broadcast; else references are counted before they meet
    the parents, and come back to their rows without gathering a hot one.
    """
    known_rows = child.select(*dict.fromkeys([*keys, *fk])).na.drop("any", subset=list(fk))
    there = _parent_keys(parent, parent_keys)
    if is_small(there):
        return known_rows.join(F.broadcast(there), _on_parent(fk, parent_keys), "left_anti")
    counts = child.select(*fk).na.drop("any").groupBy(*fk).agg(F.count("*").alias("n"))
    known = counts.join(there.withColumn("_there", F.lit(True)).hint("merge"), _on_parent(fk, parent_keys), "left").withColumn("_lost", F.lit(True))
    lost = found_in(known, F.col("_there").isNull(), ["_lost"])
    return with_group_stats(known_rows, lost, list(fk), ["_lost"]).filter("_lost").drop("_lost")


def _parent_keys(parent: DataFrame, parent_keys: Sequence[str]) -> DataFrame:
    return parent.select(*[F.col(name).alias(f"_parent_{name}") for name in parent_keys])


def _on_parent(fk: Sequence[str], parent_keys: Sequence[str]) -> list[Column]:
    return [F.col(ours) == F.col(f"_parent_{theirs}") for ours, theirs in zip(fk, parent_keys, strict=True)]


def orphan_values(child: DataFrame, fk: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]) -> DataFrame:
    """References without a parent and the number of rows ``n`` that hold them.

    References are counted before they meet the parents, so a reference that
    many rows share is one row in the join.
    """
    counts = child.select(*fk).na.drop("any").groupBy(*fk).agg(F.count("*").alias("n"))
    return counts.join(small_side(_parent_keys(parent, parent_keys)), _on_parent(fk, parent_keys), "left_anti")


def before_parent(
    child: DataFrame,
    keys: Sequence[str],
    later: str,
    fk: Sequence[str],
    parent: DataFrame,
    parent_keys: Sequence[str],
    earlier: str,
) -> DataFrame:
    """Child rows whose date lies before a date of their parent."""
    rows = child.select(*dict.fromkeys([*keys, *fk, later]))
    joined = lookup(rows, parent, dict(zip(fk, parent_keys, strict=True)), {earlier: earlier})
    return joined.filter(F.col(later) < F.col(earlier)).select(*keys, later, earlier)


def compare_with_labels(
    candidates: DataFrame, keys: Sequence[str], labels: DataFrame, rule_id: str
) -> DataFrame:
    """Candidates next to exact labels: one row of counts, precision and recall.

    ``labels`` is a journal; a row counts once however many cells it lists.
    """
    found = candidates.select(key_token(keys).alias("_token")).distinct().withColumn("_found", F.lit(1))
    here = labels.filter(F.col("rule_id") == rule_id)
    true = here.groupBy(F.coalesce("corrupted_primary_key", "primary_key").alias("_token")).agg(
        F.count("*").alias("_labels")
    )
    both = found.join(true, "_token", "full_outer")
    hits = F.count_if(F.col("_found").isNotNull() & F.col("_labels").isNotNull())
    return both.agg(
        F.count("_found").alias("candidates"),
        F.coalesce(F.sum("_labels"), F.lit(0)).alias("labels"),
        F.count("_labels").alias("affected_rows"),
        hits.alias("overlap"),
    ).select(
        F.lit(rule_id).alias("rule_id"),
        "candidates", "labels", "affected_rows", "overlap",
        F.when(F.col("candidates") > 0, F.round(F.col("overlap") / F.col("candidates"), 4)).otherwise(0.0).alias("precision"),
        F.when(F.col("affected_rows") > 0, F.round(F.col("overlap") / F.col("affected_rows"), 4)).otherwise(1.0).alias("recall"),
    )


def label_examples(journal: DataFrame, rows_per_rule: int = 5) -> DataFrame:
    """The first affected rows of each rule with their cells side by side.

    Records of a rule are numbered without gaps and in key order, so the first
    rows of a rule lie within ``rows_per_rule`` times its number of columns
    from its first record: a range filter, not a ranking of all records.
    """
    ends = journal.groupBy("rule_id").agg(
        F.min("op_seq").alias("_first"), F.collect_set("column").alias("_columns")
    )
    near = journal.join(F.broadcast(ends), "rule_id").filter(
        F.col("op_seq") < F.col("_first") + rows_per_rule * F.greatest(F.size("_columns"), F.lit(1))
    )
    cell = F.struct(
        F.coalesce("column", F.lit("*")).alias("column"),
        F.struct("corrupted_value", "clean_value").alias("values"),
    )
    rows = near.groupBy("rule_id", "table", "primary_key").agg(
        F.min("op_seq").alias("_first"), F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("cells")
    )
    order = Window.partitionBy("rule_id").orderBy("_first")
    return (
        rows.withColumn("example_no", F.row_number().over(order))
        .filter(F.col("example_no") <= rows_per_rule)
        .drop("_first")
    )
