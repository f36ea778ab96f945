"""Registered queries on tables, datasets, journals, scores and scenarios."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwell.functions import checks, fixes
from mendwell.functions.text import key_token, row_text
from mendwell.operators import compare, constraints, context, controls, detect, entities, inject, profile, recommend, repair, sampling, score
from mendwell.plans import scenarios, trade
from mendwell.plans.cases import BY_NAME, SEED
from mendwell.plans.sample_run import (
    CONTROL_CTES,
    CUSTOMER_COLUMNS,
    DIRTY_TABLES,
    SAMPLE,
    STAGE_CTES,
    TABLES,
    sample_run,
    sample_sql,
    steps,
)
from mendwell.plans.scenarios import KEY_STEP
from mendwell.plans.sqlkit import ctes, drawn_ctes, rotated_ctes, token, trade_ctes
from mendwell.session import cut_all, shared_path
from mendwell.sources import dataset as sources
from mendwell.sources import files, manifest, publish
from mendwell.spec import Dataset, Rule, TableSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name, with its SQL if there is one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def _union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _canonical_list(columns) -> str:
    return "to_json([" + ", ".join(f"{name}::VARCHAR" for name in columns) + "])::VARCHAR"


def _print_sql(source: str, columns, label: str | None = None) -> str:
    """Rows and fingerprint of a table, as one row."""
    return f"""SELECT '{label or source}' AS "table", count(*) AS rows,
        count(*) || ':' || {" || ':' || ".join(f"coalesce(sum(('0x' || substr(h, {1 + 15 * no}, 15))::HUGEINT), 0)::HUGEINT" for no in range(4))} AS fingerprint
        FROM (SELECT sha256({_canonical_list(columns)}) AS h FROM {source})"""


# Columns of the tables, in their order.
_COLUMNS = {
    "benchmark": "item_id text",
    "conversations": "conv_id turn role text",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "documents": "doc_id text lang source n_chars",
    "events": "event_id ts user_id event_type value props",
    "labels": "doc_id quality toxic",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "nation": "n_nationkey n_name n_regionkey",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "pages": "page_id url html",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "region": "r_regionkey r_name",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
}
_TRADE_COLUMNS = {
    "orders": _COLUMNS["orders"] + " o_requireddate o_shippeddate o_clerk o_shipvia o_shipname o_shipaddress o_shipcity o_shippostal o_shipcountry",
    "lineitem": "row_id " + _COLUMNS["lineitem"],
    "customer": _COLUMNS["customer"] + " c_contact c_title c_phone",
    "part": _COLUMNS["part"] + " p_suppkey p_category p_unit p_stock",
}


# --- Sources and sinks ------------------------------------------------------


@query(_union_all(f"""SELECT '{name}' AS "table", count(*) AS rows FROM {name}""" for name in trade.SOURCE_TABLES))
def table_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.row_counts(sources.load_dataset(spark, folder, [TableSpec(name, ()) for name in trade.SOURCE_TABLES]))


@query(ctes(BY_NAME["text_number"].sql_ctes()) + """
SELECT count(*) AS rows, count(TRY_CAST(l_extendedprice AS DOUBLE)) AS parsed,
       count(*) - count(TRY_CAST(l_extendedprice AS DOUBLE)) AS unparsed,
       count(l_quantity::VARCHAR::DOUBLE) AS quantities FROM dirty""")
def raw_and_typed_layers(spark: SparkSession, folder: str) -> DataFrame:
    dirty = sources.raw_text(BY_NAME["text_number"].inject(spark, folder)[0], ["l_quantity"])
    layer = sources.typed(dirty, {"l_extendedprice": "double", "l_quantity": "double"})
    return layer.agg(
        F.count("*").alias("rows"),
        F.count("l_extendedprice").alias("parsed"),
        F.count_if(F.col("l_extendedprice").isNull()).alias("unparsed"),
        F.count("l_quantity").alias("quantities"),
    )


_JOURNAL_COLUMNS = (
    "operation_id", "op_seq", "rule_id", "operation", "table", "primary_key", "column", "clean_value",
    "corrupted_value", "corrupted_primary_key", "error_type",
)
_JOURNAL_SQL = ", ".join(f'"{name}"' for name in _JOURNAL_COLUMNS)


@query(sample_sql(f"SELECT {_JOURNAL_SQL} FROM journal WHERE rule_id = 'swap'"))
def stored_manifest_records(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    path = shared_path(spark, "manifest")
    manifest.write_manifest(
        manifest.Manifest(
            plan=inject.plan_of(SAMPLE.rules, run.journal),
            journal=run.journal,
            controls=run.controls(),
            expectations=manifest.expectations_of(run.clean),
            raw_prints=manifest.expectations_of(run.dirty),
        ),
        path,
    )
    return manifest.records_for(manifest.read_manifest(spark, path).journal, "swap").select(*_JOURNAL_COLUMNS)


@query(_union_all(_print_sql(name, _COLUMNS[name].split()) for name in ("customer", "orders", "part")))
def published_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Written aside, validated by fingerprints, moved into place, read back."""
    tables = {name: trade.source(spark, folder, name) for name in ("customer", "orders", "part")}
    out = shared_path(spark, "published")

    def as_expected(written) -> bool:
        return compare.logical_match(compare.compare_datasets(tables, written)).first()["logical_match"]

    publish.publish(spark, tables, out, source=folder, validate=as_expected)
    return compare.fingerprints({name: spark.read.parquet(f"{out}/{name}") for name in tables})


@query(_union_all(_print_sql(name, _COLUMNS[name].split()) for name in ("nation", "orders")))
def published_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions published one after the other by pointers; the current one read back."""
    out = shared_path(spark, "versions")
    tables = {name: trade.source(spark, folder, name) for name in ("nation", "orders")}
    publish.publish_version(spark, {"nation": tables["nation"]}, out)
    publish.publish_version(spark, tables, out, validate=lambda written: compare.logical_match(
        compare.compare_datasets(tables, written)).first()["logical_match"])
    return compare.fingerprints(publish.read_published(spark, out))


@query(sample_sql("""SELECT rule_id, count(*) AS generated_assertions FROM journal GROUP BY rule_id"""))
def written_report(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    out = shared_path(spark, "report")
    publish.write_report(run.injected.rule_statistics, out)
    return spark.read.schema("rule_id string, generated_assertions bigint").json(out)


_AUDIT = {"nation.parquet": "mismatch", "region.parquet": "unexpected"}


@query(_union_all(
    [f"SELECT '{name}.parquet' AS file, '{_AUDIT.get(f'{name}.parquet', 'ok')}' AS status" for name in trade.SOURCE_TABLES]
    + ["SELECT 'absent.parquet', 'missing'"]
))
def file_checksum_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The table files against a list with one wrong, one missing and one
    unknown file."""
    actual = files.file_checksums(spark, folder, "*.parquet")
    listed = actual.filter("file <> 'region.parquet'").withColumn(
        "sha256", F.when(F.col("file") == "nation.parquet", F.reverse("sha256")).otherwise(F.col("sha256"))
    )
    absent = actual.filter("file = 'region.parquet'").withColumn("file", F.lit("absent.parquet"))
    return files.audit_checksums(actual, listed.unionByName(absent)).select("file", "status")


@query(sample_sql(_union_all(
    f"""SELECT l."table", l.rows AS left_rows, r.rows AS right_rows, l.fingerprint = r.fingerprint AS match
        FROM ({_print_sql(dirty, _TRADE_COLUMNS[name].split(), name)}) l
        JOIN ({_print_sql(f't_{name}', _TRADE_COLUMNS[name].split(), name)}) r USING ("table")"""
    for name, dirty in (("customer", "all_customer"), ("lineitem", "dirty_lineitem"), ("orders", "dirty_orders"), ("part", "dirty_part"))
)))
def input_precondition(spark: SparkSession, folder: str) -> DataFrame:
    """Is the input the one the expectations were made for?"""
    run = sample_run(spark, folder)
    expected = manifest.expectations_of(run.clean)
    return compare.meets_expectations(run.dirty, expected).select("table", "left_rows", "right_rows", "match")


# --- Profile and constraints ------------------------------------------------


@query(ctes(BY_NAME["missing_value"].sql_ctes()) + "\n" + _union_all(
    f"""SELECT '{name}' AS "column", count(*) - count({name}) AS null_count FROM dirty""" for name in _TRADE_COLUMNS["orders"].split()
))
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.null_counts(BY_NAME["missing_value"].inject(spark, folder)[0])


_DISTINCT = {
    "lineitem": _COLUMNS["lineitem"].split(), "events": _COLUMNS["events"].split(),
    "documents": _COLUMNS["documents"].split(), "conversations": _COLUMNS["conversations"].split(),
}


@query(_union_all(
    f"""SELECT '{table}' AS "table", '{name}' AS "column", count(DISTINCT "{name}") AS distinct_count FROM {table}"""
    for table, names in _DISTINCT.items() for name in names
))
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        profile.distinct_counts(trade.source(spark, folder, table), names).select(F.lit(table).alias("table"), "*")
        for table, names in _DISTINCT.items()
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


_KIND = """CASE WHEN v IS NULL THEN 'null' WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'integer'
           WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'real' ELSE 'text' END"""


@query(ctes(BY_NAME["text_number"].sql_ctes()) + f"""
SELECT "column", {_KIND} AS storage_type, count(*) AS cells FROM (
    SELECT 'l_extendedprice' AS "column", l_extendedprice AS v FROM dirty UNION ALL
    SELECT 'l_quantity', l_quantity::VARCHAR FROM dirty UNION ALL
    SELECT 'l_partkey', l_partkey::VARCHAR FROM dirty UNION ALL
    SELECT 'l_returnflag', l_returnflag FROM dirty) GROUP BY ALL""")
def storage_types(spark: SparkSession, folder: str) -> DataFrame:
    dirty = BY_NAME["text_number"].inject(spark, folder)[0]
    return profile.storage_types(dirty, ["l_extendedprice", "l_quantity", "l_partkey", "l_returnflag"])


_STAR = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")
_KEYS = {name: trade.SPECS[name].primary_key for name in _STAR}


@query(f"""SELECT table_name AS "table", column_name AS "column",
    CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
         WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END AS type,
    column_name IN ('o_custkey', 'l_quantity', 'c_name', 'p_name') AS not_null,
    CASE WHEN column_name IN ('o_orderkey', 'c_custkey', 'p_partkey', 's_suppkey', 'n_nationkey', 'r_regionkey') THEN 1
         WHEN column_name = 'l_partkey' THEN 2 ELSE 0 END::INTEGER AS key_place
    FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{name}'" for name in _STAR)})""")
def schema_profile(spark: SparkSession, folder: str) -> DataFrame:
    tables = {name: trade.source(spark, folder, name) for name in _STAR}
    return profile.schema_profile(Dataset(tables, {name: trade.SPECS[name] for name in _STAR}))


def _violation(table: str, constraint: str, sql: str) -> str:
    return f"""SELECT '{table}' AS "table", '{constraint}' AS "constraint", ({sql})::BIGINT AS violations"""


_BROKEN_SQL = _union_all([
    _violation("customer", "key is not null", "SELECT count(*) FROM all_customer WHERE c_custkey IS NULL"),
    _violation("customer", "not null c_name", "SELECT count(*) FROM all_customer WHERE c_name IS NULL"),
    _violation("customer", "key is unique", "SELECT count(*) - count(DISTINCT c_custkey) FROM all_customer"),
    _violation("lineitem", "key is not null", "SELECT count(*) FROM dirty_lineitem WHERE row_id IS NULL OR l_partkey IS NULL"),
    _violation("lineitem", "not null l_quantity", "SELECT count(*) FROM dirty_lineitem WHERE l_quantity IS NULL"),
    _violation("lineitem", "check quantity is positive", "SELECT count(*) FROM dirty_lineitem WHERE NOT l_quantity > 0"),
    _violation("lineitem", "check discount is a fraction", "SELECT count(*) FROM dirty_lineitem WHERE NOT l_discount BETWEEN 0 AND 1"),
    _violation("lineitem", "key is unique", "SELECT count(*) - count(DISTINCT (row_id, l_partkey)) FROM dirty_lineitem"),
    _violation("orders", "key is not null", "SELECT count(*) FROM dirty_orders WHERE o_orderkey IS NULL"),
    _violation("orders", "not null o_custkey", "SELECT count(*) FROM dirty_orders WHERE o_custkey IS NULL"),
    _violation("orders", "check price is not negative", "SELECT count(*) FROM dirty_orders WHERE NOT o_totalprice >= 0"),
    _violation("orders", "check required after ordered", "SELECT count(*) FROM dirty_orders WHERE NOT o_requireddate >= o_orderdate"),
    _violation("orders", "check shipped after ordered", "SELECT count(*) FROM dirty_orders WHERE NOT o_shippeddate >= o_orderdate"),
    _violation("orders", "key is unique", "SELECT count(*) - count(DISTINCT o_orderkey) FROM dirty_orders"),
    _violation("part", "key is not null", "SELECT count(*) FROM dirty_part WHERE p_partkey IS NULL"),
    _violation("part", "not null p_name", "SELECT count(*) FROM dirty_part WHERE p_name IS NULL"),
    _violation("part", "check stock is not negative", "SELECT count(*) FROM dirty_part WHERE NOT p_stock >= 0"),
    _violation("part", "key is unique", "SELECT count(*) - count(DISTINCT p_partkey) FROM dirty_part"),
])


@query(sample_sql(_BROKEN_SQL))
def constraint_violations(spark: SparkSession, folder: str) -> DataFrame:
    return constraints.constraint_violations(sample_run(spark, folder).dirty)


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows_with_key FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return constraints.key_duplicates(trade.source(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def _lost(child: str, column: str, parent: str, key: str) -> str:
    return f"SELECT count(*) FROM {child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent})"


_LOST_SQL = _union_all([
    _violation("customer", "reference c_nationkey -> nation", _lost("all_customer", "c_nationkey", "nation", "n_nationkey")),
    _violation("lineitem", "reference l_partkey -> part", _lost("dirty_lineitem", "l_partkey", "part", "p_partkey")),
    _violation("lineitem", "reference l_orderkey -> orders", _lost("dirty_lineitem", "l_orderkey", "orders", "o_orderkey")),
    _violation("nation", "reference n_regionkey -> region", _lost("nation", "n_regionkey", "region", "r_regionkey")),
    _violation("orders", "reference o_custkey -> customer", _lost("dirty_orders", "o_custkey", "customer", "c_custkey")),
    _violation("orders", "reference o_clerk -> supplier", _lost("dirty_orders", "o_clerk", "supplier", "s_suppkey")),
    _violation("orders", "reference o_shipvia -> region", _lost("dirty_orders", "o_shipvia", "region", "r_regionkey")),
    _violation("part", "reference p_suppkey -> supplier", _lost("dirty_part", "p_suppkey", "supplier", "s_suppkey")),
    _violation("part", "reference p_category -> nation", _lost("dirty_part", "p_category", "nation", "n_nationkey")),
    _violation("supplier", "reference s_nationkey -> nation", _lost("supplier", "s_nationkey", "nation", "n_nationkey")),
])


@query(sample_sql(_LOST_SQL))
def reference_violations(spark: SparkSession, folder: str) -> DataFrame:
    return constraints.reference_violations(_whole(spark, folder, sample_run(spark, folder).dirty))


def _whole(spark: SparkSession, folder: str, some: Dataset) -> Dataset:
    """The sample's tables and the tables they refer to."""
    rest = trade.dataset(spark, folder, ("nation", "region", "supplier"))
    return Dataset({**rest, **some}, trade.SPECS)


_PARENTS = ("nation", "region", "supplier")
_PROFILED = {**DIRTY_TABLES, **{name: name for name in _PARENTS}}
_PROFILED_COLUMNS = {name: (_TRADE_COLUMNS.get(name) or _COLUMNS[name]).split() for name in _PROFILED}
_TARGETS = profile.targets_of(SAMPLE.rules)
_TYPE = """CASE typeof(v) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
           WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' ELSE typeof(v) END"""


def _metric(table: str, column: str | None, metric: str, value: str, source: str = "") -> str:
    name = "NULL::VARCHAR" if column is None else f"'{column}'"
    return f"""SELECT '{table}' AS "table", {name} AS "column", {metric} AS metric, ({value})::VARCHAR AS value {source}"""


def _profile_sql() -> str:
    parts = []
    for table, source in _PROFILED.items():
        one = _print_sql(source, _PROFILED_COLUMNS[table], table)
        parts += [_metric(table, None, "'rows'", "rows", f"FROM ({one})"), _metric(table, None, "'fingerprint'", "fingerprint", f"FROM ({one})")]
        for column in _PROFILED_COLUMNS[table]:
            parts.append(_metric(table, column, "'null_count'", f"count(*) - count({column})", f"FROM {source}"))
            parts.append(_metric(table, column, "'declared_type'", _TYPE, f"FROM (SELECT {column} AS v FROM {source} LIMIT 1)"))
        for column in _TARGETS.get(table, ()):
            parts.append(_metric(table, column, "'distinct_count'", f"count(DISTINCT {column})", f"FROM {source}"))
            kinds = f"SELECT {_KIND} AS kind FROM (SELECT {column}::VARCHAR AS v FROM {source})"
            parts.append(_metric(table, column, "'storage_type:' || kind", "count(*)", f"FROM ({kinds}) GROUP BY kind"))
        spec = trade.SPECS[table]
        parts += [_metric(table, column, "'not_null'", "'true'") for column in spec.not_null]
        parts += [_metric(table, column, "'key_place'", str(place)) for place, column in enumerate(spec.primary_key, 1)]
    parents = _union_all(
        _violation(table, text, sql) for table in _PARENTS for key in trade.SPECS[table].primary_key
        for text, sql in (("key is not null", f"SELECT count(*) FROM {table} WHERE {key} IS NULL"),
                          ("key is unique", f"SELECT count(*) - count(DISTINCT {key}) FROM {table}")))
    broken = _union_all([_BROKEN_SQL, _LOST_SQL, parents])
    parts.append(f"""SELECT "table", NULL, "constraint", violations::VARCHAR FROM ({broken})""")
    return _union_all(parts)


@query(sample_sql(_profile_sql()))
def profile_report(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile(_whole(spark, folder, sample_run(spark, folder).dirty), _TARGETS)


@query(sample_sql("""SELECT "table", string_agg(DISTINCT "column", ',' ORDER BY "column") AS columns
    FROM journal WHERE "column" IS NOT NULL GROUP BY "table\""""))
def target_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that the rules of a journal aim at."""
    journal = sample_run(spark, folder).journal
    rules = journal.filter("column IS NOT NULL").groupBy("rule_id", "table").agg(F.collect_set("column").alias("columns"))
    return profile.target_columns(rules).select("table", F.array_join("columns", ",").alias("columns"))


# --- Fingerprints and comparison --------------------------------------------


@query(f"SELECT event_id, {_canonical_list(_COLUMNS['events'].split())} AS row_text FROM events")
def canonical_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = trade.source(spark, folder, "events")
    return df.select("event_id", row_text(df).alias("row_text"))


_EMBEDDINGS_SQL = _print_sql(
    "embeddings", ["vec_id", "to_json([floor(x::DOUBLE * 1000000 + 0.5)::BIGINT for x in embedding])", "label"]
)


def _scaled_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """In millionths, as two engines write floats differently but whole numbers alike."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1_000_000 + 0.5))
    return trade.source(spark, folder, "embeddings").select("vec_id", scaled.alias("embedding"), "label")


@query(_union_all([_print_sql(name, [f'"{c}"' for c in names.split()], name) for name, names in _COLUMNS.items()] + [_EMBEDDINGS_SQL]))
def table_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    tables = {name: trade.source(spark, folder, name) for name in _COLUMNS}
    return compare.fingerprints({**tables, "embeddings": _scaled_embeddings(spark, folder)})


@query(f"SELECT rows, fingerprint FROM ({_EMBEDDINGS_SQL})")
def embedding_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return compare.fingerprint(_scaled_embeddings(spark, folder))


def _compare_sql(left: str, right: str, name: str) -> str:
    columns = _TRADE_COLUMNS[name].split()
    return f"""SELECT '{name}' AS "table", l.rows AS left_rows, r.rows AS right_rows, l.fingerprint AS left_fingerprint,
        r.fingerprint AS right_fingerprint, l.fingerprint = r.fingerprint AS match
        FROM ({_print_sql(left, columns, name)}) l JOIN ({_print_sql(right, columns, name)}) r USING ("table")"""


@query(sample_sql(_union_all(_compare_sql(f"t_{name}", dirty, name) for name, dirty in DIRTY_TABLES.items())))
def dataset_comparison(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    return compare.compare_datasets(run.clean, run.dirty)


_ADDED = _TRADE_COLUMNS["orders"].split()[6:]


@query(f"""SELECT 'orders' AS "table", column_name AS "column", NULL::INTEGER AS left_place, place::INTEGER AS right_place
    FROM (SELECT unnest({_ADDED!r}) AS column_name, unnest(range(6, {6 + len(_ADDED)})) AS place)""")
def schema_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Stored orders against the orders that the trade dataset widens."""
    specs = {"orders": trade.SPECS["orders"]}
    left = Dataset({"orders": trade.source(spark, folder, "orders")}, specs)
    right = Dataset({"orders": trade.orders(spark, folder)}, specs)
    return compare.compare_schemas(left, right).select("table", "column", "left_place", "right_place")


@query(sample_sql("""SELECT coalesce(l.c_custkey, r.c_custkey) AS c_custkey,
    CASE WHEN l.c_custkey IS NULL THEN 'added' WHEN r.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM all_customer l FULL JOIN t_customer r USING (c_custkey)
    WHERE l.c_custkey IS NULL OR r.c_custkey IS NULL OR l.c_phone IS DISTINCT FROM r.c_phone"""))
def row_changes(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    return compare.row_diff(run.dirty["customer"], run.clean["customer"], ["c_custkey"])


@query(sample_sql("""SELECT c_custkey, 'changed' AS change, 'c_phone' AS "column", l.c_phone AS left_value, r.c_phone AS right_value
    FROM t_customer l JOIN all_customer r USING (c_custkey) WHERE l.c_phone IS DISTINCT FROM r.c_phone
    UNION ALL SELECT c_custkey, 'added', NULL, NULL, NULL FROM all_customer WHERE c_custkey NOT IN (SELECT c_custkey FROM t_customer)"""))
def cell_changes(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    return compare.cell_diff(run.clean["customer"], run.dirty["customer"], ["c_custkey"])


@query(sample_sql(_union_all(
    f"""SELECT "table", rows AS left_rows, TRUE AS match FROM ({_print_sql(f't_{name}', _TRADE_COLUMNS[name].split(), name)})"""
    for name in TABLES
)))
def expectations_after_repair(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    return compare.meets_expectations(_repaired(run), manifest.expectations_of(run.clean)).select("table", "left_rows", "match")


# --- Samples and controls ---------------------------------------------------


def _sample_sql(source: str, table: str, name: str, share: str, where: str, columns: str) -> str:
    return f"""SELECT {columns}, tok AS key_token, row_number() OVER (ORDER BY tok) - 1 AS sample_index FROM (
        SELECT *, row_number() OVER (ORDER BY md5('{SEED}|{name}|' || tok)) AS rk, count(*) OVER () AS elig
        FROM (SELECT *, {token(table)} AS tok FROM {source} WHERE {where})) WHERE rk <= {share}"""


@query(_sample_sql("orders", "orders", "exact", "150", "o_totalprice > 100000", "o_orderkey, o_totalprice"))
def sample_of_exact_size(spark: SparkSession, folder: str) -> DataFrame:
    df = trade.source(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return sampling.deterministic_sample(df, ["o_orderkey"], SEED, "exact", count=150, where="o_totalprice > 100000")


@query(ctes(trade_ctes("lineitem")) + _sample_sql("t_lineitem", "lineitem", "share", "elig // 100", "l_discount > 0", "row_id, l_partkey, l_discount"))
def sample_of_a_share(spark: SparkSession, folder: str) -> DataFrame:
    df = trade.lineitem(spark, folder).select("row_id", "l_partkey", "l_discount")
    return sampling.deterministic_sample(df, ["row_id", "l_partkey"], SEED, "share", one_in=100, where="l_discount > 0")


@query(sample_sql(_sample_sql(
    "(SELECT * FROM dirty_orders WHERE '{\"o_orderkey\":' || o_orderkey || '}' NOT IN (SELECT primary_key FROM journal WHERE \"column\" = 'o_totalprice'))",
    "orders", "unused", "elig // 20", "TRUE", "o_orderkey",
)))
def sample_of_unused_rows(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    free = sampling.without_used(run.dirty["orders"], ["o_orderkey"], "orders", ["o_totalprice"], run.journal)
    return sampling.deterministic_sample(free.select("o_orderkey"), ["o_orderkey"], SEED, "unused", one_in=20)


@query("""SELECT conv_id, turn, '{"conv_id":' || conv_id || ',"turn":' || turn || '}' AS key_token FROM conversations""")
def key_tokens(spark: SparkSession, folder: str) -> DataFrame:
    df = trade.source(spark, folder, "conversations")
    return df.select("conv_id", "turn", key_token(["turn", "conv_id"]).alias("key_token"))


@query(sample_sql("""SELECT "table", "column", count(*) AS cells FROM candidates GROUP BY ALL""", **CONTROL_CTES))
def control_candidates(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    cells = controls.control_candidates(run.clean, SAMPLE.control_scope, run.journal)
    return cells.groupBy("table", "column").agg(F.count("*").alias("cells"))


@query(sample_sql("SELECT * FROM controls", **CONTROL_CTES))
def clean_controls(spark: SparkSession, folder: str) -> DataFrame:
    return sample_run(spark, folder).controls()


# --- Journal ----------------------------------------------------------------


@query(sample_sql(f"SELECT {_JOURNAL_SQL} FROM journal"))
def fault_journal(spark: SparkSession, folder: str) -> DataFrame:
    return sample_run(spark, folder).journal.select(*_JOURNAL_COLUMNS)


@query(sample_sql("SELECT primary_key, corrupted_value FROM journal WHERE operation = 'insert_row'"))
def inserted_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sample_run(spark, folder).journal.filter("operation = 'insert_row'").select("primary_key", "corrupted_value")


@query(sample_sql("SELECT primary_key, corrupted_primary_key FROM journal WHERE corrupted_primary_key IS NOT NULL"))
def corrupted_keys(spark: SparkSession, folder: str) -> DataFrame:
    journal = sample_run(spark, folder).journal
    return journal.filter("corrupted_primary_key IS NOT NULL").select("primary_key", "corrupted_primary_key")


_RULES_SQL = _union_all(
    f"""SELECT {no}::BIGINT AS rule_no, '{rule.rule_id}' AS rule_id, {len(rule.columns)} AS width,
        '{rule.transform}' = 'duplicate_rows' AS clones, '{rule.expected_action}' AS expected_action, '{rule.severity}' AS severity,
        '{rule.table}' AS "table", '{rule.error_type}' AS error_type"""
    for no, rule in enumerate(SAMPLE.rules)
)


@query(sample_sql(
    """SELECT r.rule_no, r.rule_id, count(j.rule_id) // (CASE WHEN clones THEN 1 ELSE width END) AS requested_rows,
              count(j.rule_id) AS generated_assertions, expected_action, severity
       FROM rules r LEFT JOIN journal j ON r.rule_id = j.rule_id GROUP BY r.rule_no, r.rule_id, clones, width, expected_action, severity""",
    rules=_RULES_SQL,
))
def rule_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return sample_run(spark, folder).injected.rule_statistics.drop("description")


@query(sample_sql(
    """SELECT rule_id, affected_assertions, op_seq, primary_key, "column", corrupted_value AS raw_value, clean_value FROM (
           SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY op_seq) AS place,
                  count(*) OVER (PARTITION BY rule_id) AS affected_assertions FROM journal) WHERE place <= 3"""
))
def plan_examples(spark: SparkSession, folder: str) -> DataFrame:
    plan = inject.plan_of(SAMPLE.rules, sample_run(spark, folder).journal)
    return plan.select("rule_id", "affected_assertions", F.inline("examples"))


# --- Detection on the data as it is, and on clones --------------------------


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, o_orderdate FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""")
def shipped_before_ordered(spark: SparkSession, folder: str) -> DataFrame:
    return detect.before_parent(
        trade.source(spark, folder, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "l_shipdate",
        ["l_orderkey"], trade.source(spark, folder, "orders"), ["o_orderkey"], "o_orderdate",
    )


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def negative_balances(spark: SparkSession, folder: str) -> DataFrame:
    return detect.suspects(
        trade.source(spark, folder, "customer"), ["c_custkey"], checks.below_domain(F.col("c_acctbal")), ["c_acctbal"]
    )


@query("""SELECT doc_id, sha256(to_json([text])) AS digest, count(*) OVER (PARTITION BY text) AS rows_alike FROM documents
    QUALIFY count(*) OVER (PARTITION BY text) > 1""")
def repeated_documents(spark: SparkSession, folder: str) -> DataFrame:
    return detect.repeated_texts(trade.source(spark, folder, "documents"), ["doc_id"], ["text"])


@query(ctes(BY_NAME["outlier"].sql_ctes()) + """
SELECT row_id, l_partkey, l_quantity, usual_high FROM dirty, (
    SELECT l_quantity AS usual_high FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS place, count(*) OVER () AS n FROM dirty)
    WHERE place = (3 * n + 3) // 4) WHERE l_quantity > 3 * usual_high""")
def outliers_by_quantile(spark: SparkSession, folder: str) -> DataFrame:
    dirty = BY_NAME["outlier"].inject(spark, folder)[0]
    return context.metric_outliers(dirty, ["row_id", "l_partkey"], "l_quantity", (3, 4), 3.0)


@query(sample_sql(f"""SELECT c_custkey, c_name, c_contact, 2::BIGINT AS rows_alike FROM all_customer WHERE c_custkey > {KEY_STEP}"""))
def detect_duplicate_customers(spark: SparkSession, folder: str) -> DataFrame:
    dirty = sample_run(spark, folder).dirty["customer"]
    return detect.duplicate_entities(dirty, ["c_custkey"], ["c_name", "c_contact"], F.col("c_custkey") > KEY_STEP)


_CLONED_ORDERS = Rule("order-clone", "orders", ("o_orderkey",), "duplicate_rows", one_in=100, params={"new_pk_base": KEY_STEP})
_ORDER_IDENTITY = ("o_custkey", "o_orderdate", "o_totalprice", "o_shipname")


@query(ctes({
    **trade_ctes("orders"),
    "drawn": f"""SELECT * EXCLUDE (rk, elig), row_number() OVER (ORDER BY tok) AS no FROM (
        SELECT *, row_number() OVER (ORDER BY md5('{SEED}|order-clone|' || tok)) AS rk, count(*) OVER () AS elig
        FROM (SELECT *, {token('orders')} AS tok FROM t_orders)) WHERE rk <= elig // 100""",
    "dirty": f"SELECT * FROM t_orders UNION ALL BY NAME SELECT * EXCLUDE (tok, no) REPLACE ({KEY_STEP} + no AS o_orderkey) FROM drawn",
}) + f"""
SELECT o_orderkey, {', '.join(_ORDER_IDENTITY)}, n AS rows_alike FROM dirty
JOIN (SELECT {', '.join(_ORDER_IDENTITY)}, count(*) AS n FROM dirty GROUP BY ALL HAVING count(*) > 1) USING ({', '.join(_ORDER_IDENTITY)})
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def detect_duplicate_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders alike in all identity fields that have no line."""
    spec = trade.SPECS["orders"]
    dirty = inject.apply_rule(trade.orders(spark, folder), _CLONED_ORDERS, spec, SEED)[0]
    lines = trade.source(spark, folder, "lineitem")
    return detect.childless_duplicates(dirty, ["o_orderkey"], list(_ORDER_IDENTITY), lines, ["l_orderkey"])


@query(sample_sql("""SELECT 'blank_price' AS rule_id, count(*) FILTER (o_totalprice IS NULL) AS candidates FROM dirty_orders
    UNION ALL SELECT 'negative_price', count(*) FILTER (o_totalprice < 0) FROM dirty_orders
    UNION ALL SELECT 'missing_priority', count(*) FILTER (o_orderpriority IS NULL) FROM dirty_orders
    UNION ALL SELECT 'required_early', count(*) FILTER (o_requireddate < o_orderdate) FROM dirty_orders
    UNION ALL SELECT 'name_spaces', count(*) FILTER (p_name <> trim(p_name) OR p_name LIKE '%  %') FROM dirty_part
    UNION ALL SELECT 'hidden_name', count(*) FILTER (contains(p_name, chr(8203))) FROM dirty_part
    UNION ALL SELECT 'missing_phone', count(*) FILTER (lower(trim(c_phone)) IN ('n/a', 'na', 'unknown', '-', '')) FROM all_customer"""))
def candidate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All row-local detectors of a table in one scan."""
    return _candidate_counts(sample_run(spark, folder).dirty)


def _candidate_counts(dirty: Dataset) -> DataFrame:
    c = F.col
    orders = detect.count_suspects(dirty["orders"], {
        "blank_price": checks.missing(c("o_totalprice")),
        "negative_price": checks.below_domain(c("o_totalprice")),
        "missing_priority": checks.missing(c("o_orderpriority")),
        "required_early": checks.before(c("o_requireddate"), c("o_orderdate")),
    })
    part = detect.count_suspects(dirty["part"], {
        "name_spaces": checks.whitespace_noise(c("p_name")), "hidden_name": checks.hidden_unicode(c("p_name")),
    })
    customer = detect.count_suspects(dirty["customer"], {"missing_phone": checks.missing_word(c("c_phone"))})
    return orders.unionByName(part).unionByName(customer)


@query(sample_sql("""SELECT 'negative' AS rule_id, c.n AS candidates, l.n AS labels, l.n AS affected_rows, c.n AS overlap,
    1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall
    FROM (SELECT count(*) AS n FROM dirty_orders WHERE o_totalprice < 0) c, (SELECT count(*) AS n FROM journal WHERE rule_id = 'negative') l
    UNION ALL
    SELECT 'placeholder', c.n, l.n, l.n, l.n, round(l.n / c.n, 4), 1.0
    FROM (SELECT count(*) AS n FROM all_customer WHERE c_phone IN ('N/A', 'unknown', '-')) c,
         (SELECT count(*) AS n FROM journal WHERE rule_id = 'placeholder') l"""))
def candidates_against_labels(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    prices = detect.suspects(run.dirty["orders"], ["o_orderkey"], checks.below_domain(F.col("o_totalprice")))
    phones = detect.suspects(run.dirty["customer"], ["c_custkey"], checks.missing_word(F.col("c_phone")))
    return detect.compare_with_labels(prices, ["o_orderkey"], run.journal, "negative").unionByName(
        detect.compare_with_labels(phones, ["c_custkey"], run.journal, "placeholder")
    )


@query(sample_sql("""SELECT rule_id, "table", primary_key, example_no::INTEGER AS example_no, "column", corrupted_value, clean_value FROM (
    SELECT *, dense_rank() OVER (PARTITION BY rule_id ORDER BY primary_key) AS example_no FROM journal WHERE "column" IS NOT NULL)
    WHERE example_no <= 5"""))
def label_examples(spark: SparkSession, folder: str) -> DataFrame:
    rows = detect.label_examples(sample_run(spark, folder).journal.filter("column IS NOT NULL"), 5)
    cells = rows.select("rule_id", "table", "primary_key", "example_no", F.explode("cells").alias("column", "v"))
    return cells.select("rule_id", "table", "primary_key", "example_no", "column", "v.corrupted_value", "v.clean_value")


# --- Repair -----------------------------------------------------------------


@query(sample_sql("SELECT * FROM dirty_customer"))
def repair_duplicate_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Cloned rows go, by their labels; everything else stays as it is."""
    run = sample_run(spark, folder)
    return repair.delete_inserted(run.dirty["customer"], trade.SPECS["customer"], run.journal).select(*CUSTOMER_COLUMNS)


@query("SELECT c_custkey, c_name FROM customer")
def repair_case_by_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    dirty = BY_NAME["case_noise"].inject(spark, folder)[0]
    names = trade.source(spark, folder, "customer")
    return repair.canonical_by_vocabulary(dirty.select("c_custkey", "c_name"), "c_name", names.select(F.col("c_name").alias("word")), "word")


@query(ctes(BY_NAME["negative_value"].sql_ctes()) + "\nSELECT o_orderkey, abs(o_totalprice) AS o_totalprice FROM dirty")
def repair_without_labels(spark: SparkSession, folder: str) -> DataFrame:
    dirty = BY_NAME["negative_value"].inject(spark, folder)[0]
    price = F.col("o_totalprice")
    return repair.derive_where(dirty, "o_totalprice", checks.below_domain(price), fixes.absolute(price)).select("o_orderkey", "o_totalprice")


@query(ctes(BY_NAME["scale_drift"].sql_ctes()) + """
SELECT tok AS primary_key, new_o_totalprice AS raw_value, round(new_o_totalprice * 10, 6) AS derived_value, o_totalprice AS label FROM changes""")
def label_disagreements(spark: SparkSession, folder: str) -> DataFrame:
    """A repair by the wrong factor disagrees with every label."""
    dirty, records = BY_NAME["scale_drift"].inject(spark, folder)
    wrong = repair.label_disagreements(
        dirty, trade.SPECS["orders"], records, "o_totalprice", lambda v, _: fixes.undo_scale(v, 10, 6)
    )
    return wrong.select("primary_key", *[F.col(name).cast("double").alias(name) for name in ("raw_value", "derived_value", "label")])


@query(ctes(BY_NAME["negative_value"].sql_ctes()) + """
SELECT tok AS primary_key, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 2 END::BIGINT AS matching_rows FROM changes
WHERE o_orderstatus IN ('F', 'P')""")
def wrong_match_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Labels whose rows are gone or doubled."""
    dirty, records = BY_NAME["negative_value"].inject(spark, folder)
    damaged = dirty.filter("o_orderstatus <> 'F'").unionByName(dirty.filter("o_orderstatus = 'P'"))
    return repair.wrong_match_counts(damaged, trade.SPECS["orders"], records)


_STEP_CHECKS = {"clone": "clone", "swap": None, "key": "key", "missing": "missing", "negative": "negative", "whitespace": "whitespace"}


@query(sample_sql(_union_all(
    f"""SELECT {no} AS step, '{step}' AS rule_id, '{kind}' AS kind, {candidates} AS candidates,
        (SELECT count(*) FROM journal WHERE rule_id = '{step}') AS before, 0::BIGINT AS after"""
    for no, (step, kind, candidates) in enumerate((
        ("clone", "delete", "(SELECT count(*) FROM clones)"),
        ("swap", "swap", "NULL::BIGINT"),
        ("key", "restore", f"(SELECT count(*) FROM dirty_lineitem WHERE l_partkey >= {KEY_STEP})"),
        ("missing", "restore", "(SELECT count(*) FROM dirty_orders WHERE o_orderpriority IS NULL)"),
        ("placeholder", "restore", "(SELECT count(*) FROM dirty_customer WHERE lower(trim(c_phone)) IN ('n/a', 'na', 'unknown', '-', ''))"),
        ("negative", "derive", "(SELECT count(*) FROM dirty_orders WHERE o_totalprice < 0)"),
        ("whitespace", "derive", "(SELECT count(*) FROM dirty_part WHERE p_name <> trim(p_name) OR p_name LIKE '%  %')"),
    ), 1)
)))
def cleaning_report(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    return repair.run_steps(run.dirty, run.journal, steps()).report


@query(sample_sql(_union_all(_compare_sql(f"t_{name}", f"t_{name}", name) for name in TABLES)))
def undone_journal(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    return compare.compare_datasets(run.clean, repair.undo_journal(run.dirty, run.journal))


# --- Scores -----------------------------------------------------------------


@query(ctes(BY_NAME["text_number"].sql_ctes()) + """
, n AS (SELECT count(*) AS faults FROM changes)
SELECT 'raw' AS stage, 50.0::DOUBLE AS quality_score, 0.0::DOUBLE AS repair_accuracy, 100.0::DOUBLE AS control_preservation,
       0::BIGINT AS repaired_faults, faults AS remaining_faults, faults AS preserved_controls, 0::BIGINT AS false_positives, 0::BIGINT AS missing_rows FROM n
UNION ALL SELECT 'clean', 100.0, 100.0, 100.0, faults, 0, faults, 0, 0 FROM n""")
def quality_before_after(spark: SparkSession, folder: str) -> DataFrame:
    """Currency text in a numeric column: inject, detect, repair, score."""
    case = BY_NAME["text_number"]
    clean = trade.dataset(spark, folder, ("lineitem",))
    scenario = replace(SAMPLE, rules=(case.rule,), control_scope=(controls.ControlScope("lineitem", ("l_quantity", "l_extendedprice")),))
    made = inject.inject(clean, scenario)
    chosen = controls.draw_controls(clean, scenario, made.journal, made.faults)
    price = F.col("l_extendedprice")
    fixed = repair.derive_where(made.dataset["lineitem"], "l_extendedprice", checks.text_in_number(price), fixes.parse_currency(price))
    raw = score.quality(made.dataset, made.journal, chosen).select(F.lit("raw").alias("stage"), "*")
    done = score.quality(made.dataset.with_table("lineitem", fixed), made.journal, chosen).select(F.lit("clean").alias("stage"), "*")
    return raw.unionByName(done)


def _part_repaired(run) -> Dataset:
    """Only three of the seven rules repaired."""
    return repair.repair_all(run.dirty, run.journal, [s for s in steps() if s.rule_id in {"negative", "missing", "key"}])


@query(sample_sql("""SELECT operation_id, rule_id, rule_id IN ('negative', 'missing', 'key') AS repaired FROM journal"""))
def fault_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    return score.fault_outcomes(_part_repaired(run), run.journal).select("operation_id", "rule_id", "repaired")


@query(sample_sql("""SELECT control_id, "table", "column", NOT ("column" = 'c_name') AS preserved FROM controls""", **CONTROL_CTES))
def control_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """A repair that upper-cases every customer name harms controls."""
    run = sample_run(spark, folder)
    harmed = run.dirty.with_table("customer", run.dirty["customer"].withColumn("c_name", F.upper("c_name")))
    return score.control_outcomes(harmed, run.controls()).select("control_id", "table", "column", "preserved")


@query(sample_sql("""SELECT rule_id, error_type, count(*) FILTER (rule_id IN ('negative', 'missing', 'key')) AS repaired_faults,
    count(*) FILTER (rule_id NOT IN ('negative', 'missing', 'key')) AS remaining_faults, 0::BIGINT AS missing_rows,
    CASE WHEN rule_id IN ('negative', 'missing', 'key') THEN 100.0 ELSE 0.0 END::DOUBLE AS repair_accuracy
    FROM journal GROUP BY ALL"""))
def quality_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    return score.quality_by(_part_repaired(run), run.journal, ["rule_id", "error_type"])


@query(sample_sql("""SELECT count(*) FILTER (j."table" = 'orders' AND o_orderstatus = 'F') AS missing_rows, count(*) AS remaining_faults
    FROM journal j LEFT JOIN t_orders ON j.primary_key = '{"o_orderkey":' || o_orderkey || '}'"""))
def missing_rows(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    cut = run.dirty.with_table("orders", run.dirty["orders"].filter("o_orderstatus <> 'F'"))
    return score.quality(cut, run.journal, run.controls()).select("missing_rows", "remaining_faults")


def _repaired(run) -> Dataset:
    """All rules repaired; written once, as it is read by every check."""
    fixed = repair.repair_all(run.dirty, run.journal, steps())
    return fixed.with_tables(cut_all(fixed))


def _gate(spark: SparkSession, folder: str, run, chosen: DataFrame, candidate: Dataset) -> DataFrame:
    broken = constraints.constraint_violations(candidate).unionByName(
        constraints.reference_violations(_whole(spark, folder, candidate))
    )
    return score.gate(
        score.quality(candidate, run.journal, chosen), broken, compare.compare_datasets(run.clean, candidate)
    )


_GATE = ("quality_score", "remaining_faults", "false_positives", "violations", "matching_tables", "table_count", "passed")


_GATES_SQL = _union_all(
    f"""SELECT '{stage}' AS stage, q.*, v.n AS violations, t.same AS matching_tables, t.n AS table_count,
        quality_score = 100 AND remaining_faults = 0 AND false_positives = 0 AND v.n = 0 AND t.same = t.n AS passed
        FROM {stage}_quality q, {stage}_violations v,
             (SELECT count(*) FILTER (same) AS same, count(*) AS n FROM {stage}_tables) t""" for stage in ("clean", "raw")
)


@query(sample_sql(_GATES_SQL, **STAGE_CTES))
def release_gate(spark: SparkSession, folder: str) -> DataFrame:
    run = sample_run(spark, folder)
    chosen = run.controls()
    clean = _gate(spark, folder, run, chosen, _repaired(run))
    raw = _gate(spark, folder, run, chosen, run.dirty)
    return clean.select(F.lit("clean").alias("stage"), *_GATE).unionByName(raw.select(F.lit("raw").alias("stage"), *_GATE))


@query(sample_sql("""SELECT 'quality_score' AS measure, quality_score AS value FROM raw_quality
    UNION ALL SELECT 'matching_tables', count(*) FILTER (same) FROM raw_tables
    UNION ALL SELECT 'table_count', count(*) FROM raw_tables""", **STAGE_CTES))
def candidate_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Score and comparison with the baseline of a candidate (here the raw data)."""
    run = sample_run(spark, folder)
    found = score.quality(run.dirty, run.journal, run.controls()).select(
        F.lit("quality_score").alias("measure"), F.col("quality_score").cast("double").alias("value")
    )
    tables = compare.logical_match(compare.compare_datasets(run.clean, run.dirty))
    return found.unionByName(tables.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias("value")) for name in ("matching_tables", "table_count")
    ]))))


def _recommendations(run) -> tuple[DataFrame, DataFrame]:
    """Recommendations a profile of the dirty tables leads to, and the rules.

    Each detector with candidates makes one: by rule id, by table, columns and
    error type, with a wrong action, or for a rule nobody expects.
    """
    c = F.col
    found = _candidate_counts(run.dirty).filter("candidates > 0")
    known = {
        "negative_price": ("negative", "orders", ["o_totalprice"], "invalid_numeric_domain", " Flag_and_repair_negative_value "),
        "missing_priority": (None, "orders", ["o_orderpriority"], "missing_value", "drop_rows"),
        "name_spaces": (None, "part", ["p_name"], "whitespace_noise", "trim_and_collapse_whitespace"),
        "missing_phone": ("phone-advice", "customer", ["c_name"], "placeholder_missing", "standardize_placeholder_to_null"),
    }
    item = F.lit(None)
    for name, (rule, table, columns, error, action) in known.items():
        item = F.when(c("rule_id") == name, F.struct(
            F.lit(rule).cast("string").alias("rule_id"), F.lit(table).alias("table"),
            F.array(*[F.lit(one) for one in columns]).alias("columns"), F.lit(error).alias("error_type"),
            F.lit(action).alias("recommended_action"),
        )).otherwise(item)
    single = found.select(c("rule_id").alias("source"), item.alias("r")).select("source", "r.*")
    # The swap is told with its columns in the other order; the spaces twice.
    again = single.filter("source = 'name_spaces'")
    swap = again.withColumns({
        "source": F.lit("swap"), "columns": F.array(F.lit("p_type"), F.lit("p_brand")), "error_type": F.lit("column_misalignment"),
        "recommended_action": F.lit("detect_and_reverse_column_swap"),
    })
    provided = single.unionByName(again).unionByName(swap).withColumn("item_no", F.lit(1))
    return provided, inject.plan_of(SAMPLE.rules, run.journal)


# What detectors with candidates advise, joined with the rules by id or by table, columns and error type.
_RECOMMENDATION_CTES = {
    "rules": _union_all(
        f"""SELECT '{rule.rule_id}' AS rule_id, '{rule.table}' AS tab, list_sort({sorted(rule.columns)!r}) AS cols, '{rule.error_type}' AS error_type,
            '{rule.expected_action}' AS expected_action""" for rule in SAMPLE.rules
    ),
    "advice": """SELECT * FROM (VALUES
        ('negative_price', 'negative', 'orders', ['o_totalprice'], 'invalid_numeric_domain', ' Flag_and_repair_negative_value '),
        ('missing_priority', NULL, 'orders', ['o_orderpriority'], 'missing_value', 'drop_rows'),
        ('name_spaces', NULL, 'part', ['p_name'], 'whitespace_noise', 'trim_and_collapse_whitespace'),
        ('name_spaces', NULL, 'part', ['p_name'], 'whitespace_noise', 'trim_and_collapse_whitespace'),
        ('swap', NULL, 'part', ['p_type', 'p_brand'], 'column_misalignment', 'detect_and_reverse_column_swap'),
        ('missing_phone', 'phone-advice', 'customer', ['c_name'], 'placeholder_missing', 'standardize_placeholder_to_null')
        ) v(source, rule_id, tab, cols, error_type, action)
        WHERE CASE source WHEN 'negative_price' THEN EXISTS (FROM dirty_orders WHERE o_totalprice < 0)
            WHEN 'missing_priority' THEN EXISTS (FROM dirty_orders WHERE o_orderpriority IS NULL)
            WHEN 'missing_phone' THEN EXISTS (FROM dirty_customer WHERE lower(trim(c_phone)) IN ('n/a', 'na', 'unknown', '-', ''))
            ELSE EXISTS (FROM dirty_part WHERE p_name <> trim(p_name) OR p_name LIKE '%  %') END""",
    "provided": """SELECT source, a.rule_id AS named, coalesce(i.rule_id, g.rule_id) AS matched_rule,
            lower(trim(a.action)) = lower(trim(coalesce(i.expected_action, g.expected_action))) AS right_action
        FROM advice a LEFT JOIN rules i ON i.rule_id = a.rule_id
        LEFT JOIN rules g ON g.tab = a.tab AND g.cols = list_sort(a.cols) AND g.error_type = a.error_type""",
}


@query(sample_sql("SELECT source, matched_rule FROM provided", **_RECOMMENDATION_CTES))
def recommendation_matches(spark: SparkSession, folder: str) -> DataFrame:
    provided, expected = _recommendations(sample_run(spark, folder))
    return recommend.match_recommendations(provided, expected).select("source", "matched_rule")


@query(sample_sql("""SELECT count(*) AS provided, any_value(n) AS expected, count(DISTINCT matched_rule) AS matched,
    round(count(DISTINCT matched_rule) / count(*), 4) AS detection_precision, round(count(DISTINCT matched_rule) / any_value(n), 4) AS detection_recall,
    round(count(DISTINCT matched_rule) FILTER (right_action) / any_value(n), 4) AS action_accuracy
    FROM provided, (SELECT count(*) AS n FROM rules)""", **_RECOMMENDATION_CTES))
def recommendation_scores(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.score_recommendations(*_recommendations(sample_run(spark, folder)))


@query(sample_sql("""SELECT 'detected' AS list, matched_rule AS name FROM provided WHERE matched_rule IS NOT NULL GROUP BY matched_rule
    UNION ALL SELECT 'missed', rule_id FROM rules WHERE rule_id NOT IN (SELECT matched_rule FROM provided WHERE matched_rule IS NOT NULL)
    UNION ALL SELECT 'unknown', named FROM provided WHERE matched_rule IS NULL""", **_RECOMMENDATION_CTES))
def recommendation_lists(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.recommendation_lists(*_recommendations(sample_run(spark, folder)))


@query(sample_sql(
    f"SELECT stage AS scenario, TRUE AS complete, quality_score, passed, bool_and(passed) OVER () AS all_passed FROM ({_GATES_SQL})", **STAGE_CTES))
def verification_of_states(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of two states of the sample run, of which one does not pass."""
    run = sample_run(spark, folder)
    chosen = run.controls()
    states = {"clean": _gate(spark, folder, run, chosen, _repaired(run)), "raw": _gate(spark, folder, run, chosen, run.dirty)}
    return score.summary(states).select("scenario", "complete", "quality_score", "passed", "all_passed")


@query(sample_sql(_union_all(
    [f"""SELECT '{stage} score' AS part, 'quality_score' AS item, quality_score::VARCHAR AS value FROM {stage}_quality""" for stage in ("raw", "clean")]
    + ["SELECT 'comparison', tab, same::VARCHAR FROM clean_tables"]
    + ["SELECT 'rule', rule_id, count(*)::VARCHAR FROM journal GROUP BY rule_id"]
    + [f"""SELECT 'profile', "table" || coalesce('.' || "column", '') || ' ' || metric, value FROM ({_profile_sql()})"""]
), **STAGE_CTES))
def build_report(spark: SparkSession, folder: str) -> DataFrame:
    """Raw and clean score, comparison with the baseline, profile, rule counts."""
    run = sample_run(spark, folder)
    chosen = run.controls()
    fixed = _repaired(run)

    return score.build_report(
        score.quality(run.dirty, run.journal, chosen), score.quality(fixed, run.journal, chosen),
        compare.compare_datasets(run.clean, fixed), run.injected.rule_statistics,
        profile.profile(_whole(spark, folder, run.dirty), _TARGETS),
    )


# --- Names as they were typed ------------------------------------------------

# Each case: a remainder of the order's key, and the customer's name with up to two edits.
_TYPED = {
    1: "substr(c_name, 1, 5) || 'x' || substr(c_name, 6)",
    3: "substr(c_name, 1, 3) || substr(c_name, 5)",
    5: "substr(c_name, 1, 2) || 'Q' || substr(c_name, 4)",
    7: "substr(c_name, 1, 1) || substr(c_name, 3, 1) || substr(c_name, 2, 1) || substr(c_name, 4)",
    11: "substr(c_name, 1, 2) || 'z' || substr(c_name, 3, 4) || substr(c_name, 8)",
}
_TYPED_NAME = "CASE o_orderkey % 101 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _TYPED.items()) + " ELSE c_name END"


@query(f"""
WITH typed AS (SELECT o_orderkey, {_TYPED_NAME} AS c_name FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT c_name, count(*) AS n FROM typed GROUP BY c_name),
m AS (SELECT a.c_name, b.c_name AS canonical_name FROM n a JOIN n b
      ON b.n > a.n AND (a.n <= 3 OR a.n * 10 <= b.n) AND abs(length(a.c_name) - length(b.c_name)) <= 2 AND levenshtein(a.c_name, b.c_name) BETWEEN 1 AND 2
      QUALIFY row_number() OVER (PARTITION BY a.c_name ORDER BY b.n DESC, b.c_name) = 1)
SELECT o_orderkey, c_name, canonical_name FROM typed JOIN m USING (c_name)""")
def similar_customer_names(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = (trade.source(spark, folder, name) for name in ("orders", "customer"))
    typed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.expr(_TYPED_NAME).alias("c_name"))
    return context.similar_names(typed, ["o_orderkey"], "c_name")


# --- Entities ---------------------------------------------------------------

# Another word for a market segment.
_SEGMENTS = {"cars": "automobile", "homes": "furniture", "mach.": "machinery"}
_SAME_SEGMENT = "CASE lower(c_mktsegment) " + " ".join(f"WHEN '{meant}' THEN '{word}'" for word, meant in _SEGMENTS.items()) + " ELSE lower(c_mktsegment) END"
# Clones of some customers: the key they add, which customers, and what is written differently.
_CLONES = (
    (10_000_000, "c_custkey % 20 = 3", "upper(c_name)", "c_nationkey", "c_acctbal", _SAME_SEGMENT),
    (20_000_000, "c_custkey % 40 = 3", "concat('  ', c_name, '  ')", "c_nationkey", "c_acctbal", "'NEW'"),
    (30_000_000, "c_custkey % 60 = 3", "lower(c_name)", "c_nationkey", "c_acctbal + 1", "concat(c_mktsegment, ' ')"),
    (40_000_000, "c_custkey % 50 = 7", "c_name", "c_nationkey + 1", "c_acctbal", "'NEW'"),
)
_CLONED = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer" + "".join(
    f" UNION ALL SELECT c_custkey + {step}, {name}, {nation}, {balance}, {segment} FROM customer WHERE {where}"
    for step, where, name, nation, balance, segment in _CLONES)


@query(f"""
WITH RECURSIVE cloned AS ({_CLONED}),
n AS (SELECT c_custkey AS k, lower(trim(c_name)) AS f, c_nationkey AS g, c_acctbal AS h,
        CASE lower(trim(c_mktsegment)) {" ".join(f"WHEN '{word}' THEN '{meant}'" for word, meant in _SEGMENTS.items())} ELSE lower(trim(c_mktsegment)) END AS i
      FROM cloned),
e AS (SELECT a.k AS u, b.k AS v FROM n a JOIN n b ON a.k <> b.k
      AND 2 * (a.f = b.f)::INT + (a.g = b.g)::INT + (a.h = b.h)::INT + (a.i = b.i)::INT >= 4),
r AS (SELECT u, u AS seen FROM e UNION SELECT e.u, r.seen FROM r JOIN e ON e.v = r.u)
SELECT u AS c_custkey, min(seen) AS entity, count(DISTINCT seen) AS rows_alike FROM r GROUP BY u""")
def resolved_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and clones of them with other case, blanks, aliases and fields, as entities."""
    customer = trade.source(spark, folder, "customer")
    cloned = spark.sql(_CLONED.replace("FROM customer", "FROM {customer}"), customer=customer)
    evidence = [entities.Evidence("c_name", 2), entities.Evidence("c_nationkey"), entities.Evidence("c_acctbal"),
                entities.Evidence("c_mktsegment", 1, _SEGMENTS)]
    found = entities.resolve(cloned, ["c_custkey"], evidence, 4)
    return found.select("c_custkey", F.col("entity.c_custkey").alias("entity"), "rows_alike")


# --- Whole scenarios --------------------------------------------------------


def _clean(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, Dataset]:
    """The clean data of scenarios. Only the order lines differ; a table that is written in between is written once."""
    one = trade.dataset(spark, folder, priced=set(names) == {"context"})
    priced = "context" in names and set(names) != {"context"}
    return {name: one.with_table("lineitem", trade.kept(spark, folder, "priced")) if priced and name == "context" else one for name in names}


def _scenario_run(name: str, clean: Dataset) -> tuple[Dataset, inject.Injected, DataFrame, Dataset]:
    """Clean data, injection, controls and repaired data of a scenario."""
    scenario = scenarios.SCENARIOS[name]
    made = inject.inject(clean, scenario)
    chosen = controls.draw_controls(clean, scenario, made.journal, made.faults)
    fixed = repair.repair_all(made.dataset, made.journal, scenarios.STEPS[name]())
    fixed = fixed.with_tables(cut_all({table: fixed[table] for table in {rule.table for rule in scenario.rules}}))
    return clean, made, chosen, fixed


def _scenario_quality(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        _, made, chosen, fixed = _scenario_run(name, _clean(spark, folder, [name])[name])
        raw = score.quality(made.dataset, made.journal, chosen).select(F.lit("raw").alias("stage"), "*")
        done = score.quality(fixed, made.journal, chosen).select(F.lit("clean").alias("stage"), "*")
        return raw.unionByName(done)

    return run


def _drawn_tokens(rule: Rule, seed: int) -> str:
    """Key texts of the rows a rule draws, as a query."""
    named = drawn_ctes(rule, seed, rule.table, {column: "NULL" for column in rule.columns})
    return f"({ctes({name: named[name] for name in named if name not in ('changes', 'dirty')})} SELECT tok FROM drawn)"


def _generated_sql(name: str) -> str:
    """Assertions per rule: cells of drawn rows, for rotations those that change.

    Rules see each other through cells and keys that an earlier one has used.
    """
    scenario = scenarios.SCENARIOS[name]
    rules = {rule.rule_id: rule for rule in scenario.rules}
    parts = []
    for no, rule in enumerate(scenario.rules):
        where = rule.where.replace(f" AND l_partkey < {KEY_STEP}", "") or "TRUE"
        if rule.rule_id in {"RELATIONAL-NEGATIVE-QUANTITY", "RELATIONAL-LARGE-DISCOUNT"}:
            where += f" AND tok NOT IN {_drawn_tokens(rules['RELATIONAL-LOST-PART'], scenario.seed)}"
        if rule.rule_id == "CONTEXT-SHIPPING-BLOCK":
            where += f" AND tok NOT IN {_drawn_tokens(rules['CONTEXT-HIDDEN-CITY'], scenario.seed)}"
        if rule.rule_id == "CONTEXT-GHOST-CUSTOMER":  # cells that the earlier rule changed are used
            moved = rotated_ctes(rules["CONTEXT-MOVED-CUSTOMER"], scenario.seed, "orders")
            where += f" AND tok NOT IN ({ctes(moved)} SELECT tok FROM changes WHERE new_o_custkey IS DISTINCT FROM o_custkey)"
        placed = replace(rule, where=where)
        table = "priced" if name == "context" and rule.table == "lineitem" else rule.table
        if rule.transform == "rotate_values":
            named = rotated_ctes(placed, scenario.seed, table)
            changed = " + ".join(f"count(*) FILTER (new_{column} IS DISTINCT FROM {column})" for column in rule.columns)
        else:
            named = drawn_ctes(placed, scenario.seed, table, {column: "NULL" for column in rule.columns})
            changed = f"count(*) * {1 if rule.transform == 'duplicate_rows' else len(rule.columns)}"
        parts.append(f"""SELECT {no}::BIGINT AS rule_no, '{rule.rule_id}' AS rule_id, generated_assertions
            FROM ({ctes(named)} SELECT ({changed})::BIGINT AS generated_assertions FROM changes)""")
    return _union_all(parts)


def _scenario_sql(name: str) -> str:
    target = scenarios.SCENARIOS[name].target_quality_score
    return ctes({
        "f": _generated_sql(name),
        "n": f"""SELECT faults, round(faults * {target} / {100 - target})::BIGINT AS kept
                 FROM (SELECT sum(generated_assertions)::BIGINT AS faults FROM f)""",
    }) + """
SELECT 'raw' AS stage, round(100.0::DOUBLE * kept / (kept + faults), 4) AS quality_score, 0.0::DOUBLE AS repair_accuracy,
       100.0::DOUBLE AS control_preservation, 0::BIGINT AS repaired_faults, faults AS remaining_faults,
       kept AS preserved_controls, 0::BIGINT AS false_positives, 0::BIGINT AS missing_rows FROM n
UNION ALL SELECT 'clean', 100.0, 100.0, 100.0, faults, 0, kept, 0, 0 FROM n"""


for _name in scenarios.SCENARIOS:
    QUERIES[f"{_name}_scenario"] = _scenario_quality(_name)
    ORACLES[f"{_name}_scenario"] = _scenario_sql(_name)


def _scenario_statistics(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        made = inject.inject(trade.dataset(spark, folder, priced=name == "context"), scenarios.SCENARIOS[name])
        return made.rule_statistics.select("rule_no", "rule_id", "generated_assertions")

    return run


for _name in scenarios.SCENARIOS:
    QUERIES[f"{_name}_rule_statistics"] = _scenario_statistics(_name)
    ORACLES[f"{_name}_rule_statistics"] = _generated_sql(_name)


# A verification asks for one scenario more than there are: it is reported as incomplete, and nothing as a whole passes.
_EXPECTED = (*scenarios.SCENARIOS, "withdrawn")


@query(_union_all([
    f"""SELECT '{name}' AS scenario, TRUE AS complete, quality_score, repaired_faults, preserved_controls, TRUE AS tables_match,
        quality_score = 100 AND remaining_faults = 0 AND false_positives = 0 AS passed, FALSE AS all_passed
        FROM ({_scenario_sql(name)}) WHERE stage = 'clean'""" for name in scenarios.SCENARIOS
] + ["SELECT 'withdrawn', FALSE, NULL, NULL, NULL, NULL, FALSE, FALSE"]))
def verification_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Gates of all scenarios: score, constraints and every table against the clean data."""
    datasets = _clean(spark, folder, scenarios.SCENARIOS)

    def gate(name: str) -> DataFrame:
        scenario = scenarios.SCENARIOS[name]
        clean, made, chosen, fixed = _scenario_run(name, datasets[name])
        typed = fixed.with_tables({  # constraints hold for the types of the clean data, where faults had made text of a column
            table: fixed[table].select(*[F.col(field.name).cast(field.dataType) for field in clean[table].schema.fields])
            for table in {rule.table for rule in scenario.rules}})
        broken = constraints.constraint_violations(typed).unionByName(constraints.reference_violations(typed))
        tables = compare.compare_datasets(inject.raw_text_layer(clean, scenario.rules), fixed)
        return score.gate(score.quality(fixed, made.journal, chosen), broken, tables).withColumn(
            "tables_match", F.col("matching_tables") == F.col("table_count"))

    with ThreadPoolExecutor(max_workers=2) as pool:  # one scenario's small steps run beside the large ones of another
        gates = dict(zip(scenarios.SCENARIOS, pool.map(gate, scenarios.SCENARIOS)))
    return score.summary(gates, _EXPECTED).select(
        "scenario", "complete", "quality_score", "repaired_faults", "preserved_controls", "tables_match", "passed", "all_passed")
