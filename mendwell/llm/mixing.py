"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / quality weight, where u comes
from its id and text; within a source the documents with the smallest keys are taken
until the budget of words is used up. A target above the source's own size is
served by complete epochs first; only the rest is a selection.

No source is ever sorted whole: keys fall into slices, slices are summed, and only
the slice in which the budget runs out is looked at more closely, until it holds
few documents. What comes out is one largest key for each source, so that taking a
document is decided in its own row and no text is shuffled.

Null sources are a source of their own, the last. Null and empty texts have size 0. A null
quality weighs 1. Rows with one id and text draw the same u and are told apart by row
number; which of them is taken makes no difference. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendwell.operators.sampling import with_index
from mendwell.session import cut_lineage, small_side

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2  # times its own size that a source may be taken
SLICES = 1024
FEW = 20_000  # documents of one source that one task sorts
LIFTS = {1: 2.0, 0: 0.5}  # quality weight of a label


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, quality: DataFrame | None = None, text: str = "text", key: str = "doc_id",
             source: str = "source", carry: bool = False) -> DataFrame:
    """``row``, ``key``, ``source``, ``size`` and the sampling key ``draw`` of each row, with ``carry`` also ``rest``.

    ``quality`` holds ``key`` and a positive ``weight``, one row a key.
    """
    mark = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(source).alias("source"),
        words(F.col(text)).alias("size"),
        ((F.conv(F.substring(mark, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))).alias("u"),
        *([F.struct("*").alias("rest")] if carry else []))
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        rows = rows.join(small_side(quality.select("key", "weight")), "key", "left")
    return rows.withColumn("draw", -F.log("u") / F.coalesce("weight", F.lit(1.0))).drop("u", "weight")


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target``: shares by weight, none above ``most`` times the source."""
    sizes = cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull()))
    count = sizes.count()
    sizes = cut_lineage(with_index(sizes, ["_null", "source"], "_nth", count).withColumn(
        "_weight", F.get(F.array(*map(F.lit, weights)), F.col("_nth") % len(weights)).cast("double")))
    cap = (F.col("source_size") * most).cast("double")
    level, full = 0.0, -1
    while True:  # a source that reaches its cap leaves its excess to the others
        above = F.col("_weight") * F.lit(level) > cap
        got = sizes.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, cap)).alias("capped"),
            F.sum(F.when(~above, F.col("_weight"))).alias("open"), F.sum(above.cast("int")).alias("full")).first()
        if not got["all"] or got["full"] == full or not got["open"]:
            break
        level, full = (share * got["all"] - (got["capped"] or 0.0)) / got["open"], got["full"]
    return sizes.select("source", "source_size", F.least(cap, F.col("_weight") * F.lit(level)).alias("target"))


def _slice(width: Column) -> Column:
    inside = (1 - F.exp(-F.col("draw")) - F.col("low")) / width * SLICES
    return F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor(inside).cast("int")))


def cuts(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """``aims`` with ``epochs`` and ``cut``, the last (draw, row) that the selection takes."""
    state = cut_lineage(aims.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"),
    ).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("low", F.lit(0.0)))
    slim = rows.select("row", F.col("source").alias("_source"), "size", "draw")
    value, width = 1 - F.exp(-F.col("draw")), 1.0
    while True:  # the slice that holds the end of the budget, ever narrower
        inside = slim.join(small_side(state.select("source", "low")), F.col("_source").eqNullSafe(F.col("source"))).filter(
            (value >= F.col("low")) & (value < F.col("low") + width))
        sums = inside.groupBy("source", _slice(F.lit(width)).alias("slice")).agg(
            F.sum("size").alias("sum"), F.count(F.lit(1)).alias("rows"))
        order = Window.partitionBy("source").orderBy("slice")  # at most SLICES rows
        sums = sums.withColumn("before", F.sum("sum").over(order) - F.col("sum")).alias("s")
        hit = sums.join(small_side(state.select("source", "left")).alias("t"), F.expr("s.source <=> t.source")).filter(
            "before < left and before + sum >= left").select("s.source", "slice", "before", "rows")
        hit = cut_lineage(hit)
        width /= SLICES
        state = cut_lineage(state.alias("a").join(hit.alias("h"), F.expr("a.source <=> h.source"), "left").select(
            *(F.col(f"a.{c}") for c in ("source", "source_size", "target", "epochs")),
            (F.col("left") - F.coalesce("before", F.lit(0))).alias("left"),
            (F.col("low") + F.coalesce("slice", F.lit(0)) * F.lit(width)).alias("low")))
        largest = hit.agg(F.max("rows")).first()[0] or 0
        if largest <= FEW or width < 1e-14:
            break
    found = slim.join(small_side(state.select("source", "low", "left")), F.col("_source").eqNullSafe(F.col("source"))).filter(
        (value >= F.col("low")) & (value < F.col("low") + width) & (F.col("left") > 0))
    order = Window.partitionBy("source").orderBy("draw", "row")
    last = found.withColumn("before", F.sum("size").over(order) - F.col("size")).filter(
        F.col("before") + F.col("size") / 2 <= F.col("left"),
    ).groupBy("source").agg(F.max(F.struct("draw", "row")).alias("cut"))
    nothing = F.struct((-F.log(1 - F.col("low"))).alias("draw"), F.lit(-1).cast("long").alias("row"))
    return cut_lineage(state.alias("a").join(last.alias("l"), F.expr("a.source <=> l.source"), "left").select(
        *(F.col(f"a.{c}") for c in ("source", "source_size", "target", "epochs")),
        F.coalesce("cut", nothing).alias("cut")))


def taken(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies``, how often the mix takes a row."""
    mine = rows.withColumnRenamed("source", "_source")
    got = mine.join(small_side(limits), F.col("_source").eqNullSafe(F.col("source")))
    return got.withColumn("copies", F.col("epochs") + (F.struct("draw", "row") <= F.col("cut")).cast("int"))


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels; several labels of a document give their mean."""
    weight = F.when(F.col("quality") > 0, LIFTS[1]).when(F.col("quality") == 0, LIFTS[0]).otherwise(1.0)
    return labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("key")).agg(F.avg(weight).alias("weight"))


def report(docs: DataFrame, quality: DataFrame | None = None, text: str = "text", key: str = "doc_id",
           source: str = "source") -> DataFrame:
    """Each row with its size, its source's size and target, and the words that the mix takes of it."""
    rows = cut_lineage(measured(docs, quality, text, key, source))
    return taken(rows, cuts(rows, targets(rows))).select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, quality: DataFrame | None = None, text: str = "text", key: str = "doc_id",
        source: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    rows = cut_lineage(measured(docs, quality, text, key, source))
    limits = cuts(rows, targets(rows))
    chosen = taken(measured(docs, quality, text, key, source, carry=True), limits).filter("copies > 0")
    return chosen.select("rest", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("rest.*")
