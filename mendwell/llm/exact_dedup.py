"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of UTF-8 bytes. All distinct blocks
are sorted and numbered; then adjacent pairs of numbers are sorted and numbered
in turn, level by level, until one number is left for each document. Two
documents of equal length have the same number if and only if their bytes are
the same: numbers come from comparing contents, never from a hash.

Only one shuffle moves text, the one that sorts the distinct blocks, and each
task sends a block at most once. Numbers return to the documents by a 128-bit
address of the block. That two different blocks share an address is looked for
exactly, and then all blocks are addressed anew with another seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.session import cut_lineage

BLOCK_BYTES = 8192


def _address(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed + k), block) for k in (0, 1)]


def _blocks(data: Column, size: int) -> Column:
    count = F.ceil(F.length(data) / F.lit(size)).cast("int")
    whole = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, (i * size + 1).cast("int"), F.lit(size)),
    )
    return F.when(F.length(data) > 0, whole).otherwise(F.array().cast("array<binary>"))


def _numbered(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows, each with an integer: its place in the sort of its partition, and the partition."""
    return df.select(*columns).distinct().sortWithinPartitions(*columns).withColumn(
        "name", F.monotonically_increasing_id(),
    )


def _block_names(docs: DataFrame, size: int, seed: int) -> DataFrame | None:
    """Address and name of each distinct block, or None if two blocks share an address."""
    blocks = docs.select(F.explode(_blocks(F.col("data"), size)).alias("block"))
    low, high = _address(F.col("block"), seed)
    names = cut_lineage(_numbered(blocks, "block").select(low.alias("low"), high.alias("high"), "name"))
    shared = names.groupBy("low", "high").count().filter("count > 1")
    return names if shared.isEmpty() else None


def _rows_and_names(docs: DataFrame, text: str, key: str, block_bytes: int, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """Numbered rows, with ``carry`` also ``rest``, a struct of all columns of ``docs``; and names by row."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    named = docs.select(F.col(key).alias("key"), data.alias("data"),
                        *([F.struct("*").alias("rest")] if carry else []))
    seed = 0
    while (names := _block_names(named, block_bytes, seed)) is None:
        seed += 1
    rows = cut_lineage(named.select(
        F.monotonically_increasing_id().alias("row"), "key", F.sha2("data", 256).alias("sha"),
        F.length("data").alias("bytes"),
        F.transform(_blocks(F.col("data"), block_bytes), lambda b: F.struct(
            *(a.alias(n) for a, n in zip(_address(b, seed), ("low", "high"))))).alias("blocks"),
        *(["rest"] if carry else []),
    ))
    cells = rows.select("row", "bytes", F.posexplode("blocks").alias("place", "at")).select(
        "row", "bytes", "place", "at.low", "at.high")
    cells = cut_lineage(cells.join(names, ["low", "high"]).select("row", "bytes", "place", "name"))
    left = rows.agg(F.max(F.size("blocks")).alias("n")).first()["n"] or 0
    covered, done = block_bytes, []
    while left > 1:  # halves with each level
        done.append(cells.filter(F.col("bytes") <= covered).select("row", "name"))
        pairs = cells.filter(F.col("bytes") > covered).groupBy(
            "row", "bytes", F.floor(F.col("place") / 2).cast("int").alias("place"),
        ).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
        )
        pairs = cut_lineage(pairs)
        names = cut_lineage(_numbered(pairs, "first", "second"))
        cells = cut_lineage(pairs.join(names, ["first", "second"]).select("row", "bytes", "place", "name"))
        covered, left = covered * 2, -(-left // 2)
    final = cells.filter(F.col("bytes") <= covered).select("row", "name")
    for part in done:
        final = final.unionByName(part)
    return rows.drop("blocks"), final


def name_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its number), ``key``, ``sha`` (SHA-256 of the text, only
    to be shown), ``bytes`` and ``name``.

    ``(bytes, name)`` are equal for two rows exactly if their texts are. A null text counts as
    empty; empty texts have the name -1. Other columns may have any names.
    """
    return _named(*_rows_and_names(docs, text, key, block_bytes))


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    return rows.join(names, "row", "left").withColumn("name", F.coalesce("name", F.lit(-1)))


def mark(named: DataFrame) -> DataFrame:
    """Adds ``group_size``, ``keeper`` (struct of key and row of the row that stays) and ``kept``.

    The largest key stays, null being the smallest; of repeated rows with that key, the last.
    """
    groups = cut_lineage(named.groupBy("bytes", "name").agg(
        F.max(F.struct("key", "row")).alias("keeper"), F.count(F.lit(1)).alias("group_size")))
    return named.join(groups, ["bytes", "name"]).withColumn("kept", F.col("row") == F.col("keeper.row"))


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row of ``docs`` with the key that stays for it: ``key``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``. An empty table gives an empty result."""
    named = cut_lineage(name_texts(docs, text, key, block_bytes=block_bytes))
    return mark(named).select(
        F.col("key").alias(key), F.col("keeper.key").alias("keep_id"), "group_size", "kept",
        F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id",
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, names = _rows_and_names(docs, text, key, block_bytes, carry=True)
    slim = cut_lineage(_named(rows.drop("rest", "sha"), names))
    stay = mark(slim).filter("kept").select("row")
    return rows.join(stay, "row", "left_semi").select("rest.*")
