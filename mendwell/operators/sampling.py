"""Reproducible samples of an exact size, and dense numbering.

A row is drawn by the hash of its key: the ``k`` rows with the smallest hashes
are the sample. Hashes are spread evenly, so the place of the k-th smallest is
known but for a narrow band, and only the band is ranked. Drawing is then a
comparison inside a projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.functions.text import key_token
from mendwell.session import cut_lineage, meet

# Up to this many narrow rows are numbered by one window in one task.
ONE_TASK_ROWS = 100_000


class NotEnoughRows(ValueError):
    """Fewer rows are eligible than a rule asks for."""


@dataclass(frozen=True)
class Cut:
    """Where the drawn hashes end: ``last`` is the largest of the ``taken``."""

    last: str
    taken: int
    eligible: int

    def contains(self, hashed: Column) -> Column:
        return F.coalesce(hashed <= self.last, F.lit(False)) if self.taken else F.lit(False)


def draw_hash(seed: int, name: str, token: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|{name}|"), token))


def _hex(fraction: float) -> str:
    """The hash that so much of all hashes lies below."""
    if fraction >= 1:
        return "g"  # beyond every hash
    return f"{int(max(fraction, 0.0) * 2**52):013x}"


@dataclass(frozen=True)
class Draw:
    """A wish for rows: which are eligible, their hashes, and how many."""

    name: str
    eligible: Column
    hashed: Column
    count: int | None = None
    one_in: int | None = None


def find_cuts(df: DataFrame, draws: Sequence[Draw], span: float = 1.0) -> list[Cut]:
    """A cut per draw, through hashes that fill the first ``span`` of all hashes; together they read the table twice, however many there are.

    The first job counts eligible rows. The second counts hashes below the band
    where the last drawn one must lie and ranks the band: of k drawn rows some
    12 * sqrt(k), a few hundred thousand for a billion. Should a band miss, a
    wider one is tried.
    """
    cuts, widen = _asked(df, draws), 1
    while not all(cut.last for cut in cuts.values()):
        _rank_band(df, draws, cuts, span, widen)
        widen *= 8
    return [cuts[no] for no in range(len(draws))]


def _asked(df: DataFrame, draws: Sequence[Draw]) -> dict[int, Cut]:
    """Eligible and wanted rows of each draw; where its cut lies is open, unless it takes none or all."""
    counts = df.agg(*[F.count_if(draw.eligible).alias(f"n{no}") for no, draw in enumerate(draws)]).first()
    cuts: dict[int, Cut] = {}
    for no, draw in enumerate(draws):
        wanted = draw.count if draw.count is not None else counts[no] // draw.one_in
        if counts[no] < wanted:
            raise NotEnoughRows(f"{draw.name}: {wanted} rows wanted, only {counts[no]} eligible")
        cuts[no] = Cut("g" if wanted in (0, counts[no]) else "", wanted, counts[no])
    return cuts


def _band(cut: Cut, span: float, widen: int) -> tuple[str, str]:
    """Hashes between which the last drawn one must lie, but for one case in very many."""
    reach = widen * (6 * math.sqrt(cut.taken) + 16)
    low, high = (_hex(span * (cut.taken + way * reach) / cut.eligible) for way in (-1, 1))
    return low, high


def _rank_band(df: DataFrame, draws: Sequence[Draw], cuts: dict[int, Cut], span: float, widen: int) -> None:
    """Set the cuts that are open and lie in their band."""
    ends = []
    for no in [no for no, cut in cuts.items() if not cut.last]:
        low, high = _band(cuts[no], span, widen)
        hashed = draws[no].hashed
        near = F.struct(F.lit(no).alias("no"), F.when(hashed >= low, hashed).alias("h"))
        ends.append(F.when(draws[no].eligible & (hashed <= high), near))
    order = Window.partitionBy("no").orderBy(F.asc_nulls_first("h"))
    wanted = F.element_at(F.array(*[F.lit(cuts[no].taken) for no in range(len(draws))]), F.col("no") + 1)
    hits = (
        df.select(F.inline(F.array_compact(F.array(*ends))))
        .groupBy("no", "h")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(order))
        .filter((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted) & F.col("h").isNotNull())
        .collect()  # at most one row per draw
    )
    for hit in hits:
        cut = cuts[hit["no"]]
        if hit["upto"] != cut.taken:
            raise ValueError(f"{draws[hit['no']].name}: keys are not unique, so an exact sample does not exist")
        cuts[hit["no"]] = Cut(hit["h"], cut.taken, cut.eligible)


def kept_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition on computed columns holds; unlike in a filter, which the optimizer
    moves below their projection, each of these columns is computed once a row."""
    return df.select(F.inline(F.when(condition, F.array(F.struct(*[F.col(f"`{name}`") for name in df.columns])))))


def draw_rows(df: DataFrame, draws: Sequence[Draw], marks: Sequence[str]) -> tuple[list[Cut], DataFrame]:
    """``find_cuts``, and the rows that it drew, written on the way: they alone are ranked, and later steps need not seek them again.

    Column ``marks[no]`` says whether draw ``no`` has taken the row.
    """
    cuts, widen = _asked(df, draws), 1
    hashes = [f"_hash_{no}" for no in range(len(draws))]
    while True:
        ends = [
            F.lit(None).cast("string") if not cuts[no].taken
            else F.when(draw.eligible & (draw.hashed <= ("g" if cuts[no].last else _band(cuts[no], 1.0, widen)[1])), draw.hashed)
            for no, draw in enumerate(draws)
        ]
        near = cut_lineage(kept_where(df.withColumns(dict(zip(hashes, ends))), reduce(Column.__or__, [F.col(name).isNotNull() for name in hashes])))
        if not all(cut.last for cut in cuts.values()):
            found = [Draw(draw.name, F.col(name).isNotNull(), F.col(name)) for draw, name in zip(draws, hashes)]
            _rank_band(near, found, cuts, 1.0, widen)
        if all(cut.last for cut in cuts.values()):
            break
        widen *= 8
    taken = near.withColumns({mark: cuts[no].contains(F.col(hashes[no])) for no, mark in enumerate(marks)}).drop(*hashes)
    return [cuts[no] for no in range(len(draws))], taken.filter(reduce(Column.__or__, [F.col(mark) for mark in marks]))


def find_cut(
    hashes: DataFrame, count: int | None = None, one_in: int | None = None, what: str = "sample", span: float = 1.0
) -> Cut:
    """The cut through the column ``h``."""
    return find_cuts(hashes, [Draw(what, F.lit(True), F.col("h"), count, one_in)], span)[0]


def below(fraction: float) -> Column:
    """The hash that so much of all hashes lies below."""
    return F.lit(_hex(fraction))


def with_index(df: DataFrame, order: Sequence[str], name: str, rows: int, one_task_rows: int | None = None) -> DataFrame:
    """Number rows 0, 1, 2 … in the given order; ``rows`` bounds their number.

    Few rows are numbered by one window. Many are sorted by range, written to
    the checkpoint folder so that the partitions stay as they are, and numbered
    inside each partition after the counts of the partitions before it. A ``name``
    that ``df`` has already is refused.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name!r} already")
    if rows <= (ONE_TASK_ROWS if one_task_rows is None else one_task_rows):
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    mark = "_"
    while any(column.startswith(mark) for column in (*df.columns, name)):
        mark += "_"
    part, place, start = (mark + own for own in ("part", "place", "start"))
    placed = cut_lineage(
        df.orderBy(*order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part)
        .agg(F.count("*").alias("n"))
        .select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(start))
    )
    # One row per partition of the sort.
    numbered = placed.join(F.broadcast(starts), part).withColumn(name, (F.col(start) + F.col(place)).cast("bigint"))
    return numbered.select(*[F.col(f"`{column}`") for column in df.columns], name)


def without_used(rows: DataFrame, keys: Sequence[str], table: str, columns: Sequence[str], journal: DataFrame) -> DataFrame:
    """Drop rows of which one of ``columns`` is already in the journal."""
    used = (
        journal.filter((F.col("table") == table) & F.col("column").isin(*columns))
        .select(F.col("primary_key").alias("_token"))
        .distinct()
    )
    return meet(rows.withColumn("_token", key_token(keys)), used, ["_token"], "left_anti").drop("_token")


def deterministic_sample(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    name: str,
    count: int | None = None,
    one_in: int | None = None,
    where: str = "",
) -> DataFrame:
    """Exactly the wanted number of eligible rows, numbered in key-text order."""
    eligible = df.filter(F.expr(where)) if where.strip() else df
    token = key_token(keys)
    hashed = draw_hash(seed, name, token)
    cut = find_cut(eligible.select(hashed.alias("h")), count, one_in, name)
    drawn = eligible.filter(cut.contains(hashed)).withColumn("key_token", token)
    return with_index(drawn, ["key_token"], "sample_index", cut.taken)
