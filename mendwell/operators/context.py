"""Detectors of values that are valid on their own and wrong in their context.

Their limits are our choice. Statistics per context are mergeable aggregates
(see ``groups``), so a context that holds much of the table stays distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.functions.text import significant
from mendwell.operators.groups import (
    found_in,
    group_mode,
    group_quantiles,
    lookup,
    with_group_stats,
)
from mendwell.session import cut_lineage, small_side


def near_miss_names(
    df: DataFrame, keys: Sequence[str], name: str, max_rare: int = 3, min_ratio: int = 10
) -> DataFrame:
    """Rare names that are one exchange of neighbours, or one '?', away from a
    common one.

    Each rare name is expanded into the names it may stand for (one per pair of
    neighbours) and looked up among the names, so no pairs of names are formed.
    A name is rare up to ``max_rare`` rows or up to 1/min_ratio of the other's.
    """
    names = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("_n"))
    text = F.col("_name")
    size = F.length(text)
    swaps = F.transform(
        F.when(size >= 2, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>")),
        lambda at: F.concat(
            F.substring(text, F.lit(1), at - 1),
            F.substring(text, at + 1, F.lit(1)),
            F.substring(text, at, F.lit(1)),
            F.substring(text, at + 2, size),
        ),
    )
    stripped = F.when(F.endswith(text, F.lit("?")), F.array(F.substring(text, F.lit(1), size - 1))).otherwise(
        F.array().cast("array<string>")
    )
    spelled = names.select("_name", "_n", F.explode(F.array_distinct(F.concat(swaps, stripped))).alias("_meant"))
    common = names.select(F.col("_name").alias("_meant"), F.col("_n").alias("_common"))
    near = (
        spelled.filter(F.col("_meant") != F.col("_name"))
        .join(common, "_meant")
        .filter((F.col("_common") > F.col("_n")) & ((F.col("_n") <= max_rare) | (F.col("_n") * min_ratio <= F.col("_common"))))
        .groupBy("_name")
        .agg(F.min_by("_meant", F.struct(-F.col("_common"), F.col("_meant"))).alias("canonical_name"))
    )
    judged = names.join(near, "_name", "left").select(F.col("_name").alias(name), F.col("_n").alias("n"), "canonical_name")
    found = found_in(judged, F.col("canonical_name").isNotNull(), ["canonical_name"])
    rows = df.select(*dict.fromkeys([*keys, name]))
    return with_group_stats(rows, found, [name], ["canonical_name"]).filter(F.col("canonical_name").isNotNull())


# Names in one bucket of the deletion index that a task compares one other name with.
INDEX_BLOCK = 1000


def deletions(text: Column, most: int = 2) -> Column:
    """Hashes of the text itself and of all texts with up to ``most`` (at most 2) of its characters left out.

    Two texts within that many edits of each other have one in common.
    """
    size = F.char_length(text)

    def places(first: Column | int, last: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.when(last >= first, F.sequence(F.lit(first) if isinstance(first, int) else first, last)).otherwise(none)

    def without(*gone: Column) -> Column:
        """One text: what stands before, between and after the places left out."""
        pieces, start = [], F.lit(1)
        for place in gone:
            pieces.append(F.substring(text, start, place - start))
            start = place + 1
        return F.xxhash64(F.concat(*pieces, F.substring(text, start, F.greatest(size - start + 1, F.lit(0)))))

    found = [F.array(F.xxhash64(text))]
    if most >= 1:
        found.append(F.transform(places(1, size), lambda one: without(one)))
    if most >= 2:
        found.append(F.flatten(F.transform(
            places(1, size - 1), lambda one: F.transform(places(one + 1, size), lambda two: without(one, two)))))
    return F.array_distinct(F.concat(*found))


def similar_names(
    df: DataFrame, keys: Sequence[str], name: str, distance: int = 2, max_rare: int = 3, min_ratio: int = 10
) -> DataFrame:
    """Rare names within ``distance`` (1 or 2) edits of a more frequent one, which they get as ``canonical_name``.

    An index of deletions brings together the names that can be so near; they alone
    are compared, by their exact distance, and of several names the most frequent
    wins, then the first. A name is rare up to ``max_rare`` rows or up to
    1/min_ratio of the other's. A bucket of the index with very many frequent names is cut into
    blocks, which its rare names meet in different tasks.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    names = cut_lineage(
        df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("_n"))
    )
    most = names.agg(F.max("_n")).first()[0] or 0
    # A name of one row is never the more frequent one.
    common = names.filter(F.col("_n") > 1).select(
        F.col("_name").alias("_meant"), F.col("_n").alias("_common"), F.explode(deletions(F.col("_name"), distance)).alias("_key")
    )
    rare = names.filter((F.col("_n") <= max_rare) | (F.col("_n") * min_ratio <= most)).select(
        "_name", "_n", F.explode(deletions(F.col("_name"), distance)).alias("_key")
    )
    sizes = common.groupBy("_key").count().filter(F.col("count") > INDEX_BLOCK)
    blocks = small_side(cut_lineage(sizes.select("_key", F.ceil(F.col("count") / INDEX_BLOCK).cast("int").alias("_blocks"))))
    split = F.coalesce(F.col("_blocks"), F.lit(1))
    common = common.join(blocks, "_key", "left").withColumn("_block", F.pmod(F.xxhash64("_meant"), split).cast("int"))
    rare = rare.join(blocks, "_key", "left").withColumn("_block", F.explode(F.sequence(F.lit(0), split - 1)))
    # Estimates do not see that a name becomes some 170 rows, so both sides are told to shuffle.
    near = (
        rare.drop("_blocks")
        .hint("merge")
        .join(common.drop("_blocks").hint("merge"), ["_key", "_block"])
        .filter((F.col("_common") > F.col("_n")) & ((F.col("_n") <= max_rare) | (F.col("_n") * min_ratio <= F.col("_common"))))
        .filter(F.levenshtein("_name", "_meant", distance) > 0)  # -1 beyond the distance
        .groupBy("_name")
        .agg(F.min_by("_meant", F.struct(-F.col("_common"), F.col("_meant"))).alias("canonical_name"))
    )
    judged = names.join(near, "_name", "left").select(F.col("_name").alias(name), F.col("_n").alias("n"), "canonical_name")
    found = found_in(judged, F.col("canonical_name").isNotNull(), ["canonical_name"])
    rows = df.select(*dict.fromkeys([*keys, name]))
    return with_group_stats(rows, found, [name], ["canonical_name"]).filter(F.col("canonical_name").isNotNull())


def unlike_mode(
    df: DataFrame,
    keys: Sequence[str],
    context: Sequence[str],
    columns: Sequence[str],
    min_share: tuple[int, int] = (1, 2),
) -> DataFrame:
    """Rows whose values differ from what most rows of their context have.

    A context speaks only if its most frequent combination holds more than the
    given share of its rows. Serves address blocks per customer and ship name,
    references per entity, customers per shipping identity and discounts per
    order.
    """
    top, bottom = min_share
    modes = group_mode(df, context, list(columns), "_mode")
    modes = found_in(modes, F.col("_mode_n") * bottom > F.col("n") * top, ["_mode"])
    rows = df.select(*dict.fromkeys([*keys, *context, *columns]))
    joined = with_group_stats(rows, modes, list(context), ["_mode"])
    differs = F.lit(False)
    for column in columns:
        differs = differs | ~F.col(column).eqNullSafe(F.col(f"_mode.{column}"))
    return joined.filter(F.col("_mode").isNotNull() & differs).select(
        *keys, *[c for c in [*context, *columns] if c not in keys],
        *[F.col(f"_mode.{column}").alias(f"usual_{column}") for column in columns],
    )


def unlike_reference(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], trusted: DataFrame, trusted_keys: Sequence[str] | None = None
) -> DataFrame:
    """Rows that disagree with a trusted record of the same entity in any of the
    columns, which are judged together."""
    pairs = dict(zip(keys, trusted_keys or keys, strict=True))
    rows = df.select(*dict.fromkeys([*keys, *columns]))
    marked = trusted.withColumn("_there", F.lit(True))
    joined = lookup(rows, marked, pairs, {**{f"trusted_{c}": c for c in columns}, "_there": "_there"})
    differs = F.lit(False)
    for column in columns:
        differs = differs | ~F.col(column).eqNullSafe(F.col(f"trusted_{column}"))
    return joined.filter(F.col("_there") & differs).drop("_there")


def reassigned_parent(
    df: DataFrame,
    keys: Sequence[str],
    fk: str,
    parent: DataFrame,
    parent_key: str,
    identity: dict[str, str],
) -> DataFrame:
    """Rows whose own identity fields disagree with those of the parent they
    name, with the parent that the identity usually goes with.

    ``identity`` maps columns of the row to columns of the parent.
    """
    ours = list(identity)
    usual = group_mode(df, ours, fk, "usual").select(*ours, "n", F.col("usual").alias(f"usual_{fk}"))
    rows = df.select(*dict.fromkeys([*keys, fk, *ours]))
    joined = lookup(rows, parent, {fk: parent_key}, {f"parent_{theirs}": theirs for theirs in identity.values()})
    differs = F.lit(False)
    for one, other in identity.items():
        differs = differs | ~F.col(one).eqNullSafe(F.col(f"parent_{other}"))
    known = joined.filter(differs)
    return with_group_stats(known, usual, ours, [f"usual_{fk}"]).select(
        *keys, *[c for c in [fk, *ours] if c not in keys], f"usual_{fk}"
    )


def rare_pairs(
    df: DataFrame, keys: Sequence[str], context: Sequence[str], assignee: str, below: tuple[int, int] = (1, 20)
) -> DataFrame:
    """Rows whose assignee takes less than the given share of their context."""
    top, bottom = below
    pairs = df.na.drop("any", subset=[*context, assignee]).groupBy(*context, assignee).agg(F.count("*").alias("n"))
    totals = pairs.groupBy(*context).agg(F.sum("n").alias("context_rows"))
    shares = with_group_stats(pairs, totals, list(context), ["context_rows"], "context_rows").withColumn(
        "pair_rows", F.col("n")
    )
    found = found_in(shares, F.col("n") * bottom < F.col("context_rows") * top, ["pair_rows", "context_rows"])
    rows = df.select(*dict.fromkeys([*keys, *context, assignee]))
    joined = with_group_stats(rows, found, [*context, assignee], ["pair_rows", "context_rows"])
    return joined.filter(F.col("pair_rows").isNotNull())


def shifted_dates(
    df: DataFrame, keys: Sequence[str], date: str, related: str, low_days: int, high_days: int, shift_days: int = 365
) -> DataFrame:
    """Dates that fit their related date only after moving them back."""
    lag = F.date_diff(F.col(related).cast("date"), F.col(date).cast("date"))
    return df.filter(
        ~lag.between(low_days, high_days) & (lag + shift_days).between(low_days, high_days)
    ).select(*dict.fromkeys([*keys, date, related]), lag.alias("lag_days"))


def scale_drift(
    df: DataFrame, keys: Sequence[str], context: Sequence[str], value: str, below: float = 0.05
) -> DataFrame:
    """Values far below the median of their context, as a lost factor leaves them."""
    medians = group_quantiles(df, context, value, {"context_median": (1, 2)})
    rows = df.select(*dict.fromkeys([*keys, *context, value]))
    joined = with_group_stats(rows, medians, list(context), ["context_median"])
    return joined.filter(F.col(value) / F.col("context_median") < below)


def outside_fences(
    df: DataFrame, keys: Sequence[str], context: Sequence[str], value: str, reach: float = 1.5
) -> DataFrame:
    """Values beyond the quartile fences of their context."""
    quartiles = group_quantiles(df, context, value, {"q1": (1, 4), "q3": (3, 4)})
    fences = quartiles.select(
        *context, "n",
        (F.col("q1") - reach * (F.col("q3") - F.col("q1"))).alias("low_fence"),
        (F.col("q3") + reach * (F.col("q3") - F.col("q1"))).alias("high_fence"),
    )
    rows = df.select(*dict.fromkeys([*keys, *context, value]))
    joined = with_group_stats(rows, fences, list(context), ["low_fence", "high_fence"])
    return joined.filter((F.col(value) < F.col("low_fence")) | (F.col(value) > F.col("high_fence")))


def far_from_mean(
    df: DataFrame, keys: Sequence[str], context: Sequence[str], value: str, deviations: float = 2.0
) -> DataFrame:
    """Values more than so many standard deviations from their context's mean."""
    number = F.col(value).cast("double")
    sums = df.filter(F.col(value).isNotNull()).groupBy(*context).agg(
        F.count("*").alias("n"), F.avg(number).alias("_mean"), F.stddev_samp(number).alias("_deviation")
    )
    # Rounded, as the last digits depend on the order in which partial sums meet.
    stats = sums.filter("n > 1").select(
        *context, "n", significant(F.col("_mean")).alias("mean"), significant(F.col("_deviation")).alias("deviation")
    )
    rows = df.select(*dict.fromkeys([*keys, *context, value]))
    joined = with_group_stats(rows, stats, list(context), ["mean", "deviation"])
    return joined.filter(
        (F.col("deviation") > 0) & (F.abs(F.col(value) - F.col("mean")) > deviations * F.col("deviation"))
    )


def unlike_history(
    master: DataFrame,
    keys: Sequence[str],
    price: str,
    history: DataFrame,
    history_keys: Sequence[str],
    paid: Column,
    low: float = 0.5,
    high: float = 2.0,
) -> DataFrame:
    """Master prices out of line with the median paid in their own sales."""
    sales = history.select(
        *[F.col(theirs).alias(ours) for ours, theirs in zip(keys, history_keys, strict=True)], paid.alias("_paid")
    )
    medians = group_quantiles(sales, keys, "_paid", {"median_paid": (1, 2)})
    joined = master.select(*dict.fromkeys([*keys, price])).join(medians, list(keys))
    ratio = F.col(price) / F.col("median_paid")
    return joined.filter((ratio < low) | (ratio > high)).select(*keys, price, "median_paid")


def metric_outliers(df: DataFrame, keys: Sequence[str], value: str, quantile: tuple[int, int], factor: float) -> DataFrame:
    """Values above a multiple of a high quantile of the whole column."""
    limits = group_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, {"usual_high": quantile})
    return (
        df.withColumn("_all", F.lit(1))
        .join(F.broadcast(limits.select("_all", "usual_high")), "_all")  # one row
        .filter(F.col(value) > factor * F.col("usual_high"))
        .select(*keys, value, "usual_high")
    )
