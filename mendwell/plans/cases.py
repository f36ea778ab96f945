"""One case per kind of fault: put it in, find it, repair it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwell.functions import checks, fixes
from mendwell.functions.text import key_token
from mendwell.operators import context, detect
from mendwell.operators import repair as repairs
from mendwell.operators.inject import apply_rule
from mendwell.plans import trade
from mendwell.plans.scenarios import KEY_STEP, MISSING_CUSTOMER, TYPE_ALIASES, TYPE_NAMES
from mendwell.plans.sqlkit import ctes, drawn_ctes, rotated_ctes, trade_ctes
from mendwell.spec import Rule, TableSpec

SEED = 1907

Detect = Callable[[SparkSession, str, DataFrame, TableSpec], DataFrame]


@dataclass(frozen=True)
class Case:
    """A rule on a table, its SQL counterpart, a detector and a repair.

    ``new_sql`` gives the faulty value per column; ``detect_sql`` is a query
    over ``dirty``. ``numeric`` columns are compared as numbers, not as text.
    """

    name: str
    table: str
    rule: Rule
    new_sql: Mapping[str, str]
    detect: Detect | None = None
    detect_sql: str = ""
    repair: str = "restore"
    fix: Callable[[Column, Column], Column] | None = None
    numeric: bool = False
    text: bool = False
    detect_tables: tuple[str, ...] = field(default=())

    @property
    def spec(self) -> TableSpec:
        return trade.SPECS["lineitem" if self.table == "priced" else self.table]

    def inject(self, spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
        df = trade.kept(spark, folder, self.table)
        return apply_rule(df, self.rule, self.spec, SEED)

    def sql_ctes(self) -> dict[str, str]:
        text = list(self.new_sql) if self.text else []
        if self.rule.transform == "rotate_values":
            named = rotated_ctes(self.rule, SEED, self.table)
        else:
            named = drawn_ctes(self.rule, SEED, self.table, self.new_sql, text=text)
        return {**trade_ctes(*self.detect_tables), **named}


def _value(name: str, numeric: bool) -> Column:
    return F.col(name).try_cast("double") if numeric else F.col(name).cast("string")


def inject_query(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        records = case.inject(spark, folder)[1]
        return records.select(
            "primary_key", "column",
            _value("clean_value", case.numeric).alias("clean_value"),
            _value("corrupted_value", case.numeric and not case.text).alias("corrupted_value"),
        )

    return run


def _cell_sql(case: Case, old: str, new: str, new_numeric: bool) -> str:
    kind = "DOUBLE" if case.numeric else "VARCHAR"
    new_kind = "DOUBLE" if new_numeric else "VARCHAR"
    parts = [
        f"""SELECT tok AS primary_key, '{name}' AS "column", {name}::{kind} AS {old}, new_{name}::{new_kind} AS {new}
            FROM changes WHERE new_{name} IS DISTINCT FROM {name}{'::VARCHAR' if case.text else ''}"""
        for name in case.rule.columns
    ]
    return ctes(case.sql_ctes()) + "\n" + "\nUNION ALL\n".join(parts)


def inject_sql(case: Case) -> str:
    return _cell_sql(case, "clean_value", "corrupted_value", case.numeric and not case.text)


def detect_query(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return case.detect(spark, folder, case.inject(spark, folder)[0], case.spec)

    return run


def detect_sql(case: Case) -> str:
    return ctes(case.sql_ctes()) + "\n" + case.detect_sql


def repair_query(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    """Cells that the repair changed, raw and repaired."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        dirty, records = case.inject(spark, folder)
        spec, columns = case.spec, list(case.rule.columns)
        df = dirty.withColumns({f"raw_{name}": F.col(name) for name in columns})
        if case.repair == "derive":
            fixed = repairs.derive(df, spec, records, {name: case.fix for name in columns})
        elif case.repair == "swap":
            fixed = repairs.reverse_swap(df, spec, records, *columns)
        else:
            fixed = repairs.restore_labels(df, spec, records, columns)
        cells = F.array(*[
            F.struct(
                F.lit(name).alias("column"),
                _value(name, case.numeric).alias("repaired_value"),
                _value(f"raw_{name}", case.numeric and not case.text).alias("raw_value"),
                F.col(name).eqNullSafe(F.col(f"raw_{name}")).alias("same"),
            )
            for name in columns
        ])
        return (
            fixed.select(key_token(spec.primary_key).alias("primary_key"), F.inline(cells))
            .filter(~F.col("same"))
            .drop("same")
        )

    return run


def repair_sql(case: Case) -> str:
    return _cell_sql(case, "repaired_value", "raw_value", case.numeric and not case.text)


def _rule(name: str, table: str, columns: str, transform: str, one_in: int, where: str = "", **params) -> Rule:
    return Rule(name, "lineitem" if table == "priced" else table, tuple(columns.split()), transform, one_in=one_in, where=where, params=params)


def _local(check: Callable[[Column], Column], column: str, *evidence: str) -> Detect:
    return lambda spark, folder, dirty, spec: detect.suspects(
        dirty, spec.primary_key, check(F.col(column)), [column, *evidence]
    )


_KEYS = {"orders": "o_orderkey", "lineitem": "row_id, l_partkey", "priced": "row_id, l_partkey", "customer": "c_custkey", "part": "p_partkey"}


def _local_sql(table: str, column: str, predicate: str, *evidence: str) -> str:
    return f"SELECT {', '.join([_KEYS[table], column, *evidence])} FROM dirty WHERE {predicate}"


def _modes(context_columns: str, columns: str, source: str = "dirty") -> str:
    """SQL for the dominant combination per context."""
    return f"""(SELECT * FROM (
        SELECT {context_columns}, {columns}, n,
               row_number() OVER (PARTITION BY {context_columns} ORDER BY n DESC, {columns}) AS place,
               sum(n) OVER (PARTITION BY {context_columns}) AS total
        FROM (SELECT {context_columns}, {columns}, count(*) AS n FROM {source} GROUP BY {context_columns}, {columns})
    ) WHERE place = 1)"""


_BLOCK = "o_shipaddress o_shipcity o_shippostal o_shipcountry"
_BLOCK_COLUMNS = _BLOCK.split()

CASES = [
    Case(
        "missing_value", "orders", _rule("missing", "orders", "o_orderpriority", "null", 20, "o_orderpriority IS NOT NULL"),
        {"o_orderpriority": "NULL"},
        _local(checks.missing, "o_orderpriority", "o_custkey", "o_shipcity", "o_shipcountry"),
        _local_sql("orders", "o_orderpriority", "o_orderpriority IS NULL", "o_custkey", "o_shipcity", "o_shipcountry"),
    ),
    Case(
        "placeholder", "customer", _rule("placeholder", "customer", "c_phone", "placeholder", 10, "c_phone IS NOT NULL"),
        {"c_phone": "['N/A', 'unknown', '-'][idx % 3 + 1]"},
        _local(checks.missing_word, "c_phone"),
        _local_sql("customer", "c_phone", "lower(trim(c_phone)) IN ('n/a', 'na', 'unknown', '-', '')"),
    ),
    Case(
        "whitespace", "part", _rule("whitespace", "part", "p_name", "pad_whitespace", 10),
        {"p_name": "'  ' || replace(p_name, ' ', '  ') || '   '"},
        _local(checks.whitespace_noise, "p_name"),
        _local_sql("part", "p_name", "p_name <> trim(p_name) OR p_name LIKE '%  %' OR contains(p_name, chr(9))"),
        "derive", lambda v, _: fixes.collapse_whitespace(v),
    ),
    Case(
        "case_noise", "customer", _rule("case", "customer", "c_name", "case_noise", 10),
        {"c_name": "CASE WHEN idx % 2 = 0 THEN lower(c_name) ELSE upper(c_name) END"},
        _local(checks.single_case, "c_name"),
        _local_sql("customer", "c_name", "c_name = upper(c_name) OR c_name = lower(c_name)"),
        "derive", fixes.canonical_case,
    ),
    Case(
        "mixed_date", "orders", _rule("date", "orders", "o_orderdate", "date_format", 20),
        {"o_orderdate": """CASE idx % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M')
                           WHEN 1 THEN strftime(o_orderdate, '%m-%d-%Y %H:%M:%S') ELSE strftime(o_orderdate, '%Y/%m/%d %H:%M') END"""},
        _local(checks.not_iso_date, "o_orderdate"),
        _local_sql("orders", "o_orderdate", "NOT regexp_matches(o_orderdate, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')"),
        "derive", fixes.normalize_date, text=True,
    ),
    Case(
        "text_number", "lineitem", _rule("text", "lineitem", "l_extendedprice", "prefixed_numeric", 50, prefix="USD "),
        {"l_extendedprice": "'USD ' || l_extendedprice::VARCHAR"},
        _local(checks.text_in_number, "l_extendedprice"),
        _local_sql("lineitem", "l_extendedprice", "l_extendedprice IS NOT NULL AND TRY_CAST(l_extendedprice AS DOUBLE) IS NULL"),
        "derive", lambda v, _: fixes.parse_currency(v), numeric=True, text=True,
    ),
    Case(
        "percent_text", "lineitem", _rule("percent", "lineitem", "l_discount", "percent_string", 50, "l_discount > 0"),
        {"l_discount": r"regexp_replace(round(l_discount * 100, 6)::DECIMAL(38, 6)::VARCHAR, '\.?0+$', '') || '%'"},
        _local(checks.percent_text, "l_discount"),
        _local_sql("lineitem", "l_discount", "l_discount LIKE '%\\%' ESCAPE '\\'"),
        "derive", lambda v, _: fixes.parse_percent(v), numeric=True, text=True,
    ),
    Case(
        "outlier", "lineitem", _rule("outlier", "lineitem", "l_quantity", "multiply", 50, "l_quantity > 0", factor=100),
        {"l_quantity": "l_quantity * 100::DOUBLE"},
        _local(lambda v: checks.at_least(v, 100), "l_quantity"),
        _local_sql("lineitem", "l_quantity", "l_quantity >= 100"),
        "derive", lambda v, _: fixes.undo_factor(v), numeric=True,
    ),
    Case(
        "fraction_range", "lineitem", _rule("range", "lineitem", "l_discount", "multiply", 50, "l_discount >= 0.05", factor=100),
        {"l_discount": "l_discount * 100::DOUBLE"},
        _local(checks.outside_fraction, "l_discount"),
        _local_sql("lineitem", "l_discount", "NOT l_discount BETWEEN 0 AND 1"),
        "derive", lambda v, _: fixes.percentage_to_fraction(v), numeric=True,
    ),
    Case(
        "corrupted_key", "lineitem", _rule("key", "lineitem", "l_partkey", "add", 50, increment=KEY_STEP),
        {"l_partkey": f"l_partkey + {KEY_STEP}"},
        lambda spark, folder, dirty, spec: detect.orphans(
            dirty, ["row_id"], ["l_partkey"], trade.table(spark, folder, "part"), ["p_partkey"]
        ),
        "SELECT row_id, l_partkey FROM dirty WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part)",
    ),
    Case(
        "lost_reference", "orders", _rule("orphan", "orders", "o_custkey", "invalid_fk", 20, value=MISSING_CUSTOMER),
        {"o_custkey": f"{MISSING_CUSTOMER}::BIGINT"},
        lambda spark, folder, dirty, spec: detect.orphans(
            dirty, spec.primary_key, ["o_custkey"], trade.table(spark, folder, "customer"), ["c_custkey"]
        ),
        "SELECT o_orderkey, o_custkey FROM dirty WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)",
    ),
    Case(
        "scale_drift", "orders", _rule("scale", "orders", "o_totalprice", "scale", 20, "o_totalprice > 0", factor=0.01),
        {"o_totalprice": "o_totalprice * 0.01::DOUBLE"},
        lambda spark, folder, dirty, spec: context.scale_drift(dirty, spec.primary_key, ["o_orderpriority"], "o_totalprice", 0.02),
        """SELECT o_orderkey, o_orderpriority, o_totalprice, context_median FROM dirty
           JOIN (SELECT o_orderpriority, o_totalprice AS context_median FROM (
               SELECT o_orderpriority, o_totalprice, row_number() OVER w AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n
               FROM dirty WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice)) WHERE place = (n + 1) // 2)
           USING (o_orderpriority) WHERE o_totalprice / context_median < 0.02""",
        "derive", lambda v, _: fixes.undo_scale(v, digits=6), numeric=True,
    ),
    Case(
        "category_alias", "part", _rule("alias", "part", "p_type", "country_alias", 10, aliases=TYPE_ALIASES),
        {"p_type": "CASE p_type WHEN 'ECONOMY' THEN 'Econ.' WHEN 'SMALL' THEN 'Sml' WHEN 'STANDARD' THEN 'Std.' ELSE lower(p_type) END"},
        _local(lambda v: checks.known_alias(v, TYPE_NAMES), "p_type"),
        _local_sql("part", "p_type", "p_type IN ('Econ.', 'Sml', 'Std.', 'large', 'medium', 'promo')"),
        "derive", lambda v, _: fixes.canonical_alias(v, TYPE_NAMES),
    ),
    Case(
        "negative_value", "orders", _rule("negative", "orders", "o_totalprice", "negative", 20, "o_totalprice >= 0"),
        {"o_totalprice": "CASE WHEN o_totalprice = 0 THEN -1 ELSE -abs(o_totalprice) END"},
        _local(checks.below_domain, "o_totalprice"),
        _local_sql("orders", "o_totalprice", "o_totalprice < 0"),
        "derive", lambda v, _: fixes.absolute(v), numeric=True,
    ),
    Case(
        "negative_stock", "part", _rule("stock", "part", "p_stock", "negative", 10, "p_stock >= 0"),
        {"p_stock": "CASE WHEN p_stock = 0 THEN -1 ELSE -abs(p_stock) END"},
        _local(lambda v: checks.below_domain(v, strict=False), "p_stock"),
        _local_sql("part", "p_stock", "p_stock <= 0"), numeric=True,
    ),
    Case(
        "date_sequence", "orders",
        _rule("sequence", "orders", "o_requireddate", "date_before", 20, source_column="o_orderdate", days=30),
        {"o_requireddate": "o_orderdate - INTERVAL 30 DAY"},
        lambda spark, folder, dirty, spec: detect.suspects(
            dirty, spec.primary_key, checks.before(F.col("o_requireddate"), F.col("o_orderdate")), ["o_requireddate", "o_orderdate"]
        ),
        "SELECT o_orderkey, o_requireddate, o_orderdate FROM dirty WHERE o_requireddate < o_orderdate",
    ),
    Case(
        "date_shift", "orders", _rule("shift", "orders", "o_orderdate", "date_shift", 20, days=365),
        {"o_orderdate": "o_orderdate + INTERVAL 365 DAY"},
        lambda spark, folder, dirty, spec: context.shifted_dates(dirty, spec.primary_key, "o_orderdate", "o_shippeddate", 0, 60),
        """SELECT o_orderkey, o_orderdate, o_shippeddate, date_diff('day', o_orderdate, o_shippeddate)::INTEGER AS lag_days
           FROM dirty WHERE date_diff('day', o_orderdate, o_shippeddate) NOT BETWEEN 0 AND 60
           AND date_diff('day', o_orderdate, o_shippeddate) + 365 BETWEEN 0 AND 60""",
        "derive", lambda v, label: fixes.undo_day_shift(v, 365, label),
    ),
    Case(
        "hidden_unicode", "part", _rule("hidden", "part", "p_name", "zero_width", 10),
        {"p_name": "substr(p_name, 1, greatest(1, length(p_name) // 2)) || chr(8203) || substr(p_name, greatest(1, length(p_name) // 2) + 1)"},
        _local(checks.hidden_unicode, "p_name"),
        _local_sql("part", "p_name", "contains(p_name, chr(8203)) OR contains(p_name, chr(65279))"),
        "derive", lambda v, _: fixes.remove_hidden(v),
    ),
    Case(
        "name_typo", "part", _rule("typo", "part", "p_name", "typo", 50),
        {"p_name": """CASE WHEN substr(p_name, length(p_name) // 2, 1) = substr(p_name, length(p_name) // 2 + 1, 1) THEN p_name || '?'
                      ELSE substr(p_name, 1, length(p_name) // 2 - 1) || substr(p_name, length(p_name) // 2 + 1, 1)
                           || substr(p_name, length(p_name) // 2, 1) || substr(p_name, length(p_name) // 2 + 2) END"""},
        lambda spark, folder, dirty, spec: context.near_miss_names(dirty, spec.primary_key, "p_name"),
        """, names AS (SELECT p_name, count(*) AS n FROM dirty GROUP BY p_name),
           near AS (SELECT r.p_name, c.p_name AS canonical_name,
                           row_number() OVER (PARTITION BY r.p_name ORDER BY c.n DESC, c.p_name) AS place
                    FROM names r JOIN names c ON c.n > r.n AND (r.n <= 3 OR r.n * 10 <= c.n)
                    AND ((length(r.p_name) = length(c.p_name) AND levenshtein(r.p_name, c.p_name) = 2
                          AND damerau_levenshtein(r.p_name, c.p_name) = 1) OR r.p_name = c.p_name || '?'))
           SELECT p_partkey, p_name, canonical_name FROM dirty JOIN near USING (p_name) WHERE place = 1""",
    ),
    Case(
        "swapped_columns", "part", _rule("swap", "part", "p_brand p_type", "swap_columns", 20, "p_brand <> p_type"),
        {"p_brand": "p_type", "p_type": "p_brand"},
        lambda spark, folder, dirty, spec: detect.swapped_columns(dirty, spec.primary_key, "p_brand", "p_type"),
        """, words AS (SELECT word, sum(l) AS l, sum(r) AS r FROM (
               SELECT p_brand AS word, 1 AS l, 0 AS r FROM dirty UNION ALL SELECT p_type, 0, 1 FROM dirty) GROUP BY word)
           SELECT p_partkey, p_brand, p_type FROM dirty
           WHERE p_brand IN (SELECT word FROM words WHERE r > l) AND p_type IN (SELECT word FROM words WHERE l > r)""",
        "swap",
    ),
    Case(
        "line_price", "priced", _rule("price", "priced", "l_unitprice", "rotate_values", 30, "l_unitprice > 0", shift=37),
        {}, lambda spark, folder, dirty, spec: context.outside_fences(dirty, spec.primary_key, ["l_partkey"], "l_unitprice"),
        """, ranked_prices AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_unitprice) AS place,
                               count(*) OVER (PARTITION BY l_partkey) AS n FROM dirty),
           fences AS (SELECT l_partkey, max(CASE WHEN place = (n + 3) // 4 THEN l_unitprice END) AS q1,
                             max(CASE WHEN place = (3 * n + 3) // 4 THEN l_unitprice END) AS q3 FROM ranked_prices GROUP BY l_partkey)
           SELECT row_id, l_partkey, l_unitprice, q1 - 1.5::DOUBLE * (q3 - q1) AS low_fence, q3 + 1.5::DOUBLE * (q3 - q1) AS high_fence
           FROM dirty JOIN fences USING (l_partkey)
           WHERE l_unitprice < q1 - 1.5::DOUBLE * (q3 - q1) OR l_unitprice > q3 + 1.5::DOUBLE * (q3 - q1)""",
        numeric=True,
    ),
    Case(
        "line_quantity", "lineitem", _rule("quantity", "lineitem", "l_quantity", "rotate_values", 40, "l_quantity > 0", shift=53),
        {}, lambda spark, folder, dirty, spec: context.far_from_mean(dirty, spec.primary_key, ["l_partkey"], "l_quantity"),
        """, stats AS (SELECT l_partkey, printf('%.8e', avg(l_quantity))::DOUBLE AS mean,
               printf('%.8e', stddev_samp(l_quantity))::DOUBLE AS deviation FROM dirty GROUP BY l_partkey HAVING count(*) > 1)
           SELECT row_id, l_partkey, l_quantity, mean, deviation FROM dirty JOIN stats USING (l_partkey)
           WHERE deviation > 0 AND abs(l_quantity - mean) > 2 * deviation""",
        numeric=True,
    ),
    Case(
        "line_discount", "lineitem", _rule("discount", "lineitem", "l_discount", "rotate_values", 60, "l_discount > 0", shift=29),
        {}, lambda spark, folder, dirty, spec: context.unlike_mode(dirty, spec.primary_key, ["l_orderkey"], ["l_discount"]),
        f"""SELECT row_id, d.l_partkey, d.l_orderkey, d.l_discount, m.l_discount AS usual_l_discount FROM dirty d
            JOIN {_modes('l_orderkey', 'l_discount')} m USING (l_orderkey) WHERE m.n * 2 > m.total AND d.l_discount <> m.l_discount""",
        numeric=True,
    ),
    Case(
        "moved_customer", "orders", _rule("customer", "orders", "o_custkey", "rotate_values", 20, shift=41),
        {}, lambda spark, folder, dirty, spec: context.reassigned_parent(
            dirty, spec.primary_key, "o_custkey", trade.table(spark, folder, "customer"), "c_custkey", {"o_shipname": "c_name"}
        ),
        f"""SELECT o_orderkey, d.o_custkey, d.o_shipname, m.o_custkey AS usual_o_custkey FROM dirty d
            LEFT JOIN customer ON d.o_custkey = c_custkey LEFT JOIN {_modes('o_shipname', 'o_custkey')} m ON m.o_shipname = d.o_shipname
            WHERE d.o_shipname IS DISTINCT FROM c_name""",
    ),
    Case(
        "moved_clerk", "orders", _rule("clerk", "orders", "o_clerk", "rotate_values", 25, shift=17),
        {}, lambda spark, folder, dirty, spec: context.rare_pairs(dirty, spec.primary_key, ["o_custkey"], "o_clerk", (1, 5)),
        """SELECT o_orderkey, o_custkey, o_clerk, pair_rows, context_rows FROM (
               SELECT *, count(*) OVER (PARTITION BY o_custkey, o_clerk) AS pair_rows, count(*) OVER (PARTITION BY o_custkey) AS context_rows
               FROM dirty WHERE o_custkey IS NOT NULL AND o_clerk IS NOT NULL) WHERE pair_rows * 5 < context_rows""",
    ),
    Case(
        "moved_shipper", "orders", _rule("shipper", "orders", "o_shipvia", "rotate_values", 25, shift=11),
        {}, lambda spark, folder, dirty, spec: context.rare_pairs(dirty, spec.primary_key, ["o_shipcity"], "o_shipvia", (1, 20)),
        """SELECT o_orderkey, o_shipcity, o_shipvia, pair_rows, context_rows FROM (
               SELECT *, count(*) OVER (PARTITION BY o_shipcity, o_shipvia) AS pair_rows, count(*) OVER (PARTITION BY o_shipcity) AS context_rows
               FROM dirty) WHERE pair_rows * 20 < context_rows""",
        numeric=True,
    ),
    Case(
        "wrong_supplier", "part", _rule("supplier", "part", "p_suppkey", "rotate_values", 20, shift=7),
        {}, lambda spark, folder, dirty, spec: context.unlike_reference(
            dirty, spec.primary_key, ["p_suppkey"], trade.table(spark, folder, "part")
        ),
        """SELECT d.p_partkey, d.p_suppkey, t.p_suppkey AS trusted_p_suppkey FROM dirty d JOIN t_part t USING (p_partkey)
           WHERE d.p_suppkey IS DISTINCT FROM t.p_suppkey""",
    ),
    Case(
        "wrong_category", "orders", _rule("category", "orders", "o_shipvia", "rotate_values", 20, shift=9),
        {}, lambda spark, folder, dirty, spec: context.unlike_mode(dirty, spec.primary_key, ["o_shipname"], ["o_shipvia"]),
        f"""SELECT o_orderkey, d.o_shipname, d.o_shipvia, m.o_shipvia AS usual_o_shipvia FROM dirty d
            JOIN {_modes('o_shipname', 'o_shipvia')} m USING (o_shipname) WHERE m.n * 2 > m.total AND d.o_shipvia <> m.o_shipvia""",
        numeric=True,
    ),
    Case(
        "product_category", "part", _rule("partcategory", "part", "p_category", "rotate_values", 20, shift=33),
        {}, lambda spark, folder, dirty, spec: context.unlike_reference(
            dirty, spec.primary_key, ["p_category"], trade.table(spark, folder, "part")
        ),
        """SELECT d.p_partkey, d.p_category, t.p_category AS trusted_p_category FROM dirty d JOIN t_part t USING (p_partkey)
           WHERE d.p_category IS DISTINCT FROM t.p_category""",
    ),
    Case(
        "contact_pair", "customer", _rule("contact", "customer", "c_contact c_title", "rotate_values", 20, shift=13),
        {}, lambda spark, folder, dirty, spec: context.unlike_reference(
            dirty, spec.primary_key, ["c_contact", "c_title"], trade.table(spark, folder, "customer")
        ),
        """SELECT d.c_custkey, d.c_contact, d.c_title, t.c_contact AS trusted_c_contact, t.c_title AS trusted_c_title
           FROM dirty d JOIN t_customer t USING (c_custkey)
           WHERE d.c_contact IS DISTINCT FROM t.c_contact OR d.c_title IS DISTINCT FROM t.c_title""",
    ),
    Case(
        "list_price", "part", _rule("listprice", "part", "p_retailprice", "rotate_values", 20, "p_retailprice > 0", shift=19),
        {}, lambda spark, folder, dirty, spec: context.unlike_history(
            dirty, ["p_partkey"], "p_retailprice", trade.table(spark, folder, "priced"), ["l_partkey"], F.col("l_unitprice"), 0.999, 1.001
        ),
        """, paid AS (SELECT l_partkey, l_unitprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_unitprice) AS place,
                             count(*) OVER (PARTITION BY l_partkey) AS n FROM t_priced)
           SELECT p_partkey, p_retailprice, l_unitprice AS median_paid FROM dirty JOIN paid ON p_partkey = l_partkey AND place = (n + 1) // 2
           WHERE p_retailprice / l_unitprice < 0.999 OR p_retailprice / l_unitprice > 1.001""",
        numeric=True, detect_tables=("priced",),
    ),
    Case(
        "shipping_block", "orders", _rule("block", "orders", _BLOCK, "rotate_values", 25, shift=31),
        {}, lambda spark, folder, dirty, spec: context.unlike_mode(
            dirty, spec.primary_key, ["o_custkey", "o_shipname"], _BLOCK_COLUMNS
        ),
        f"""SELECT o_orderkey, d.o_custkey, d.o_shipname, {', '.join(f'd.{c}' for c in _BLOCK_COLUMNS)},
                   {', '.join(f'm.{c} AS usual_{c}' for c in _BLOCK_COLUMNS)}
            FROM dirty d JOIN {_modes('o_custkey, o_shipname', ', '.join(_BLOCK_COLUMNS))} m USING (o_custkey, o_shipname)
            WHERE m.n * 2 > m.total AND ({' OR '.join(f'd.{c} IS DISTINCT FROM m.{c}' for c in _BLOCK_COLUMNS)})""",
    ),
]

BY_NAME = {case.name: case for case in CASES}


def case_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for case in CASES:
        out[f"inject_{case.name}"] = inject_query(case)
        out[f"detect_{case.name}"] = detect_query(case)
        out[f"repair_{case.name}"] = repair_query(case)
    return out


def case_oracles() -> dict[str, str]:
    out = {}
    for case in CASES:
        out[f"inject_{case.name}"] = inject_sql(case)
        out[f"detect_{case.name}"] = detect_sql(case)
        out[f"repair_{case.name}"] = repair_sql(case)
    return out
