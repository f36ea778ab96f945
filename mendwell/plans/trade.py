"""The test tables as a trade database: orders with shipping fields, order
lines, customers with contacts, parts with references and stock.

Each table has a Spark builder and, for the SQL checks, an equal CTE.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwell.operators.groups import lookup
from mendwell.session import cut_lineage, is_small
from mendwell.spec import Dataset, ForeignKey, TableSpec

SOURCE_TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
    "orders", "pages", "part", "region", "supplier",
)

SPECS = {
    "orders": TableSpec(
        "orders", ("o_orderkey",),
        (
            ForeignKey(("o_custkey",), "customer", ("c_custkey",)),
            ForeignKey(("o_clerk",), "supplier", ("s_suppkey",)),
            ForeignKey(("o_shipvia",), "region", ("r_regionkey",)),
        ),
        ("o_custkey",),
        {
            "price is not negative": "o_totalprice >= 0",
            "required after ordered": "o_requireddate >= o_orderdate",
            "shipped after ordered": "o_shippeddate >= o_orderdate",
        },
    ),
    "lineitem": TableSpec(
        "lineitem", ("row_id", "l_partkey"),
        (ForeignKey(("l_partkey",), "part", ("p_partkey",)), ForeignKey(("l_orderkey",), "orders", ("o_orderkey",))),
        ("l_quantity",),
        {"quantity is positive": "l_quantity > 0", "discount is a fraction": "l_discount BETWEEN 0 AND 1"},
    ),
    "customer": TableSpec("customer", ("c_custkey",), (ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),), ("c_name",)),
    "part": TableSpec(
        "part", ("p_partkey",),
        (
            ForeignKey(("p_suppkey",), "supplier", ("s_suppkey",)),
            ForeignKey(("p_category",), "nation", ("n_nationkey",)),
        ),
        ("p_name",),
        {"stock is not negative": "p_stock >= 0"},
    ),
    "supplier": TableSpec("supplier", ("s_suppkey",), (ForeignKey(("s_nationkey",), "nation", ("n_nationkey",)),)),
    "nation": TableSpec("nation", ("n_nationkey",), (ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),)),
    "region": TableSpec("region", ("r_regionkey",)),
}

TITLES = ("Owner", "Buyer", "Agent", "Clerk")


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with dates to come, an assignee, a shipper and a shipping block."""
    days = lambda n: F.make_dt_interval(F.lit(n))
    with_customer = lookup(
        source(spark, folder, "orders"), source(spark, folder, "customer"), {"o_custkey": "c_custkey"},
        {"o_shipname": "c_name", "_nation": "c_nationkey"},
    )
    with_nation = lookup(
        with_customer, source(spark, folder, "nation"), {"_nation": "n_nationkey"}, {"o_shipcountry": "n_name"}
    )
    return with_nation.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        (F.col("o_orderdate") + days(30)).alias("o_requireddate"),
        (F.col("o_orderdate") + days(7)).alias("o_shippeddate"),
        (F.col("o_custkey") % 10).alias("o_clerk"),
        (F.col("_nation") % 5).alias("o_shipvia"),
        "o_shipname",
        F.concat(F.lit("Dock "), (F.col("o_custkey") % 97).cast("string")).alias("o_shipaddress"),
        F.concat(F.lit("City "), F.col("_nation").cast("string")).alias("o_shipcity"),
        F.lpad((F.col("o_custkey") % 1000).cast("string"), 5, "0").alias("o_shippostal"),
        "o_shipcountry",
    )


def _with_row_id(df: DataFrame) -> DataFrame:
    row_id = F.concat_ws(
        "|", *[F.col(name).cast("string") for name in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
        F.substring(F.col("l_shipdate").cast("string"), 1, 10),
    )
    return df.select(row_id.alias("row_id"), *df.columns)


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with a surrogate key, made before any fault."""
    return _with_row_id(source(spark, folder, "lineitem"))


def priced_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the list price of their part as unit price."""
    # The long surrogate key is made after the lookup, which may have to shuffle.
    return _with_row_id(lookup(
        source(spark, folder, "lineitem"), source(spark, folder, "part"), {"l_partkey": "p_partkey"}, {"l_unitprice": "p_retailprice"}
    ))


def customer(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    titles = F.array(*[F.lit(title) for title in TITLES])
    return source(spark, folder, "customer").select(
        "*",
        F.concat(F.lit("Contact "), key.cast("string")).alias("c_contact"),
        F.element_at(titles, (key % len(TITLES) + 1).cast("int")).alias("c_title"),
        F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("-"), F.lpad(key.cast("string"), 7, "0")).alias("c_phone"),
    )


def part(spark: SparkSession, folder: str) -> DataFrame:
    return source(spark, folder, "part").select(
        "*",
        (F.col("p_partkey") % 10).alias("p_suppkey"),
        (F.col("p_partkey") % 25).cast("int").alias("p_category"),
        F.concat(F.col("p_size").cast("string"), F.lit(" boxes")).alias("p_unit"),
        F.col("p_size").alias("p_stock"),
    )


_BUILDERS = {"orders": orders, "lineitem": lineitem, "customer": customer, "part": part}

SQL_TABLES = {
    "t_orders": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
               o_orderdate + INTERVAL 30 DAY AS o_requireddate, o_orderdate + INTERVAL 7 DAY AS o_shippeddate,
               o_custkey % 10 AS o_clerk, c_nationkey % 5 AS o_shipvia, c_name AS o_shipname,
               'Dock ' || (o_custkey % 97) AS o_shipaddress, 'City ' || c_nationkey AS o_shipcity,
               lpad((o_custkey % 1000)::VARCHAR, 5, '0') AS o_shippostal, n_name AS o_shipcountry
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "t_lineitem": """
        SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d')) AS row_id, *
        FROM lineitem""",
    "t_priced": """
        SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d')) AS row_id,
               lineitem.*, p_retailprice AS l_unitprice
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "t_customer": """
        SELECT *, 'Contact ' || c_custkey AS c_contact,
               ['Owner', 'Buyer', 'Agent', 'Clerk'][c_custkey % 4 + 1] AS c_title,
               lpad(c_nationkey::VARCHAR, 2, '0') || '-' || lpad(c_custkey::VARCHAR, 7, '0') AS c_phone
        FROM customer""",
    "t_part": """
        SELECT *, p_partkey % 10 AS p_suppkey, (p_partkey % 25)::INTEGER AS p_category, p_size || ' boxes' AS p_unit,
               p_size AS p_stock
        FROM part""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name == "priced":
        return priced_lineitem(spark, folder)
    return _BUILDERS[name](spark, folder) if name in _BUILDERS else source(spark, folder, name)


# Tables that take columns from a parent, and which.
_LOOKED_UP = {"orders": ("customer", ("c_custkey", "c_name", "c_nationkey")), "priced": ("part", ("p_partkey", "p_retailprice"))}


def kept(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for several readers: where the lookup of its parent shuffles, it is done once and written."""
    df = table(spark, folder, name)
    if name not in _LOOKED_UP:
        return df
    parent, columns = _LOOKED_UP[name]
    return df if is_small(source(spark, folder, parent).select(*columns)) else cut_lineage(df)


def dataset(spark: SparkSession, folder: str, names: Iterable[str] = tuple(SPECS), priced: bool = False) -> Dataset:
    tables = {name: kept(spark, folder, "priced" if priced and name == "lineitem" else name) for name in names}
    return Dataset(tables, {name: SPECS[name] for name in tables})
