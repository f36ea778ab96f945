"""Queries next to their SQL, and the pipeline next to plain Python, at the smallest scale."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from check import rows_of
from mendwell.llm import queries
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_near_dups import brute as near_classes


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, tiny, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tiny}/{table}.parquet'")
    df, want = queries.QUERIES[name](spark, tiny), con.execute(queries.oracle_sql()[name])
    columns = [item[0] for item in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, want.fetchall())


def test_every_stage(spark, tiny, tiny_docs, tmp_path):
    def texts(df):
        return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    stages, docs, tables = dict(corpus_pipeline.STAGES), tiny_docs, {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, tiny)
        assert name == "packing" or made.columns == tiny_docs.columns
        made.write.parquet(str(tmp_path / name))
        docs = tables[name] = spark.read.parquet(str(tmp_path / name))
    assert list(stages) == ["quality", "exact_dedup", "near_duplicates", "mixing", "packing"]

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    good = texts(tables["quality"])
    wrong = [k for k, q in labels.items() if (k in good) != (q == 1)]
    assert len(wrong) <= 0.08 * len(labels)  # learnt from some 70 labels
    last = {t: k for k, t in sorted(good.items())}
    single = texts(tables["exact_dedup"])
    assert single == {k: t for t, k in last.items()}
    left = texts(tables["near_duplicates"])
    assert set(left) == {c for _, c, _ in near_classes(list(single.items()))}
    rows = [tuple(r) for r in tables["near_duplicates"].select("doc_id", "text", "source").collect()]
    weights = {k: 2.0 if q == 1 else 0.5 for k, q in labels.items()}
    copies = Counter(r.doc_id for r in tables["mixing"].select("doc_id").collect())
    assert copies == Counter({k: t // n for k, n, _, _, t in mixed(rows, weights) if n and t})
    pieces = tables["packing"].collect()
    words = {k: len(left[k].split()) for k in copies}
    assert {k: sum(r.length for r in pieces if r.doc_id == k) for k in words} == {k: n * copies[k] for k, n in words.items()}
    used = Counter()
    for r in pieces:
        used[r.sequence, r.capacity] += r.length
    assert all(n <= c for (_, c), n in used.items())
    whole = corpus_pipeline.run(spark, tiny).select("doc_id", "piece", "start", "length").collect()
    assert Counter(map(tuple, whole)) == Counter((r.doc_id, r.piece, r.start, r.length) for r in pieces)


def test_the_pipeline_on_odd_and_empty_tables(spark, tiny, odd_docs, no_docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, docs in (("odd", odd_docs), ("empty", no_docs)):
        docs.select(*columns).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{tiny}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
        made = corpus_pipeline.run(spark, str(tmp_path / name))
        rows = made.collect()
        assert made.columns == ["doc_id", "piece", "start", "length", "sequence", "offset", "capacity"]
        assert all(r.offset is None or r.offset + r.length <= r.capacity for r in rows)
        assert name == "odd" or rows == []
