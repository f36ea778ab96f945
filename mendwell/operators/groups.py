"""Group statistics that survive hot groups.

A third of all rows may share one key. So statistics are built from mergeable
partial aggregates, quantiles from counts in ever narrower bins, and
statistics go back to their rows without sending a hot group to one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell import session
from mendwell.session import cut_lineage, is_small, small_side

# A group this large is hot. A table of N rows has at most N / HOT_ROWS hot
# groups, one narrow row each, which bounds what is broadcast.
HOT_ROWS = 5_000_000
HOT_SPREAD = 1024


def with_group_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    size: str = "n",
    hot_rows: int | None = None,
) -> DataFrame:
    """Left-join one row of statistics per group to the rows of the group.

    ``stats`` has one row per key and the number of rows in ``size``. Rows of a
    hot group get their statistics from a broadcast and are spread over many
    partitions in the join that serves all other groups, so the rows are read
    once and no task takes a whole hot group. Join keys are matched by ``=``:
    rows with a NULL in their key get NULL statistics. ``stats`` must list every
    hot group, also those without a finding: see ``found_in``. Rows are spread
    by a hash of all their columns, so they should be distinct (hold a key).
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    hot_keys = [F.col(key).alias(f"_hot_{key}") for key in keys]
    hot_values = [F.col(value).alias(f"_hot_{value}") for value in values]
    hot = F.broadcast(stats.filter(F.col(size) >= hot_rows).select(*hot_keys, *hot_values, F.lit(1).alias("_hot")))
    cold = stats.filter(F.col(size) < hot_rows).select(
        *[F.col(key).alias(f"_cold_{key}") for key in keys],
        *[F.col(value).alias(f"_cold_{value}") for value in values],
        # Always 0, but not as a literal: a literal would turn the spread from a
        # join key into a mere condition, and hot rows would meet in one task.
        F.pmod(F.xxhash64(*keys), F.lit(1)).alias("_cold_spread"),
    )
    on_hot = [F.col(key) == F.col(f"_hot_{key}") for key in keys]
    # A hot row, or one without a key, matches nothing below: it only has to go
    # somewhere, and its spread number says where.
    nowhere = F.col("_hot").isNotNull()
    for key in keys:
        nowhere = nowhere | F.col(key).isNull()
    spread = F.when(nowhere, F.pmod(F.xxhash64(*rows.columns), F.lit(HOT_SPREAD)) + 1).otherwise(0)
    marked = rows.join(hot, on_hot, "left").withColumn("_spread", spread)
    on_cold = [F.col(key) == F.col(f"_cold_{key}") for key in keys] + [F.col("_spread") == F.col("_cold_spread")]
    joined = marked.join(cold, on_cold, "left")
    picked = [F.coalesce(F.col(f"_cold_{value}"), F.col(f"_hot_{value}")).alias(value) for value in values]
    return joined.select(*rows.columns, *picked)


def found_in(stats: DataFrame, finding: Column, values: Sequence[str], size: str = "n") -> DataFrame:
    """Statistics of the groups with a finding; of the rest only the hot ones
    stay, with NULL values, so that ``with_group_stats`` knows them as hot."""
    return stats.filter(finding | (F.col(size) >= HOT_ROWS)).withColumns({
        name: F.when(finding, F.col(name)) for name in values
    })


def group_mode(rows: DataFrame, keys: Sequence[str], value: str | Sequence[str], name: str = "mode") -> DataFrame:
    """Most frequent value per group; a tie goes to the smallest value.

    Pairs are counted first, so a hot group reaches the second step as its
    distinct values, and that step is a mergeable maximum. ``value`` may be a
    list of columns, which are then compared as one struct.
    """
    item = F.col(value) if isinstance(value, str) else F.struct(*value)
    known = rows.select(*keys, item.alias("_value")).filter(F.col("_value").isNotNull())
    pairs = known.groupBy(*keys, "_value").agg(F.count("*").alias("_n"))
    best = F.min_by("_value", F.struct(-F.col("_n"), F.col("_value")))
    return pairs.groupBy(*keys).agg(
        best.alias(name), F.max("_n").alias(f"{name}_n"), F.sum("_n").alias("n")
    )


# Up to so many rows of a group are ranked by one task.
RANK_ROWS = 1_000_000
BINS = 2048
_HALF = 1 << 62


def order_key(value: Column) -> Column:
    """An integer of 63 bits that never falls where a double rises; next to each other, two doubles may share one.

    It is put together from the exponent and the 52 bits below it; scaling by powers of two is exact.
    """
    size = F.abs(value)
    guess = F.greatest(F.least(F.coalesce(F.floor(F.log2(size)), F.lit(-1000)), F.lit(1023)), F.lit(-1000))

    def scaled(exponent: Column) -> Column:
        return size * F.pow(F.lit(2.0), (-exponent).cast("double"))

    # the logarithm may be rounded over the edge of its power of two
    exponent = guess + F.when(scaled(guess) >= 2, 1).when((scaled(guess) < 1) & (guess > -1000), -1).otherwise(0)
    key = ((exponent + 1001) * F.lit(1 << 52) + ((scaled(exponent) - 1) * F.lit(float(1 << 52))).cast("bigint")).cast("bigint")
    finite = F.shiftright(F.when(value < 0, -key).otherwise(key), 1)
    return F.when(F.isnan(value), F.lit(_HALF - 1)).when(
        size == float("inf"), F.when(value < 0, F.lit(1 - _HALF)).otherwise(F.lit(_HALF - 2))).otherwise(finite)


def group_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, tuple[int, int]],
    rank_rows: int | None = None,
) -> DataFrame:
    """Exact discrete quantiles per group, however large it is; no task ranks more than ``rank_rows`` rows of one.

    ``quantiles`` maps an output name to a fraction ``(numerator, denominator)``;
    the result is the value at rank ``ceil(fraction * n)``. Groups within the limit are sorted by one task
    each. Larger ones are never sorted: counts in bins of an order-keeping integer tell in which
    bin a rank lies, and that bin is cut into bins again, until what is left in it is
    within the limit or of one value. A level leaves a 2048th of the range, so there
    are at most six. Also returns ``n``, the number of values. Rows without a key are in no group.
    """
    keys = list(keys)
    limit = RANK_ROWS if rank_rows is None else rank_rows
    keyed = [F.col(key).isNotNull() for key in keys]
    known = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        reduce(lambda one, other: one & other, keyed, F.col("_v").isNotNull())
    )
    number = order_key(F.col("_v"))
    sizes = cut_lineage(known.groupBy(*keys).agg(F.count("*").alias("n"), F.min(number).alias("_lo"), F.max(number).alias("_hi")))
    large = sizes.filter(F.col("n") > limit)
    if large.isEmpty():
        return _ranked(known, keys, quantiles)
    names = small_side(large.select(*keys))
    few = _ranked(known.join(names, keys, "left_anti"), keys, quantiles)
    many = cut_lineage(known.join(names, keys, "left_semi").withColumn("_key", number))
    return few.unionByName(_narrowed(many, large, keys, quantiles, limit))


def _rank(n: Column, top: int, bottom: int) -> Column:
    return F.ceil(n * top / bottom).cast("bigint")


def _ranked(known: DataFrame, keys: list[str], quantiles: dict[str, tuple[int, int]]) -> DataFrame:
    """Quantiles of groups that one task can sort."""
    group = Window.partitionBy(*keys)
    placed = known.withColumns({"_nth": F.row_number().over(group.orderBy("_v")), "n": F.count("*").over(group)})
    ranks = {name: _rank(F.col("n"), *part) for name, part in quantiles.items()}
    hit = reduce(lambda one, other: one | other, [F.col("_nth") == rank for rank in ranks.values()])
    return placed.filter(hit).groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("_nth") == rank, F.col("_v"))).alias(name) for name, rank in ranks.items()]
    )


def _window_rows(many: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of large groups inside the windows that their quantiles may still lie in."""
    return many.join(small_side(windows), keys).filter(F.col("_key").between(F.col("_lo"), F.col("_hi")))


def _in_window(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The value at the rank of each window; equal values are counted before they meet."""
    order = Window.partitionBy(*keys, "_name").orderBy("_v")
    counted = rows.groupBy(*keys, "_name", "_rank", "n", "_v").agg(F.count("*").alias("_n"))
    upto = counted.withColumn("_upto", F.sum("_n").over(order))
    return upto.filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))


def _narrowed(
    many: DataFrame, large: DataFrame, keys: list[str], quantiles: dict[str, tuple[int, int]], limit: int
) -> DataFrame:
    wanted = F.array(*[
        F.struct(F.lit(name).alias("_name"), _rank(F.col("n"), *part).alias("_rank")) for name, part in quantiles.items()
    ])
    columns = [*keys, "n", "_name", "_rank", "_lo", "_hi"]
    windows, done = large.select(*keys, "n", "_lo", "_hi", F.inline(wanted)).select(*columns), []
    while True:
        step = F.expr(f"(_hi - _lo) div {BINS} + 1")
        bins = _window_rows(many, windows.withColumn("_step", step), keys).groupBy(
            *columns, "_step", F.expr("(_key - _lo) div _step").alias("_bin")).agg(F.count("*").alias("_n"))
        order = Window.partitionBy(*keys, "_name").orderBy("_bin")  # at most BINS rows
        low = F.col("_lo") + F.col("_bin") * F.col("_step")
        hit = bins.withColumn("_upto", F.sum("_n").over(order)).filter(
            (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
        narrow = cut_lineage(hit.select(
            *keys, "n", "_name", (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank"),
            low.alias("_lo"), F.least(F.col("_hi"), low + F.col("_step") - 1).alias("_hi"), "_n"))
        fits = (F.col("_n") <= limit) | (F.col("_lo") == F.col("_hi"))
        done.append(narrow.filter(fits).select(*columns))
        windows = narrow.filter(~fits).select(*columns)
        if windows.isEmpty():
            break
    found = _in_window(_window_rows(many, reduce(DataFrame.unionByName, done), keys), keys)
    return found.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in quantiles]
    )


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """All keys that hold very many rows, as a 64-bit hash in ``_hash``, and their numbers of rows.

    Rows are counted before they move, so a hot key is a row a task.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    counts = rows.groupBy(F.xxhash64(*keys).alias("_hash")).agg(F.count("*").alias("_size"))
    return counts.filter(F.col("_size") >= hot_rows)


def lookup(
    rows: DataFrame,
    parent: DataFrame,
    keys: dict[str, str],
    values: dict[str, str],
    parent_rows: int | None = None,
    broadcast_rows: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Left-join columns of a parent with unique keys to its child rows.

    ``keys`` maps child to parent columns, ``values`` output names to parent
    columns. A parent found small is broadcast; otherwise rows of hot keys take
    their parent from a broadcast and all others meet theirs in a shuffle.
    """
    side = parent.select(
        *[F.col(theirs).alias(f"_key_{ours}") for ours, theirs in keys.items()],
        *[F.col(theirs).alias(name) for name, theirs in values.items()],
    )
    limit = session.BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if is_small(side, limit) if parent_rows is None else parent_rows <= limit:
        on = [F.col(ours) == F.col(f"_key_{ours}") for ours in keys]
        return rows.join(F.broadcast(side), on, "left").select(*rows.columns, *values)
    stats = side.select(*[F.col(f"_key_{ours}").alias(ours) for ours in keys], *values)
    sizes = F.broadcast(hot_keys(rows, list(keys), hot_rows=hot_rows))
    sized = stats.join(sizes, F.xxhash64(*keys) == F.col("_hash"), "left").withColumn(
        "_size", F.coalesce(F.col("_size"), F.lit(0))
    )
    return with_group_stats(rows, sized.drop("_hash"), list(keys), list(values), "_size", hot_rows)
