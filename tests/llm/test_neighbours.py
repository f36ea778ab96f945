import numpy as np
import pytest

from mendwell.llm import neighbours


def exact(ids, x, nearest=10):
    out = {}
    for at in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[at]][:nearest]
        out[int(ids[at])] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")


def test_recall_and_scores(spark, tiny):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got, want = found(neighbours.report(df)), exact(ids, x)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    place = {int(i): v for i, v in zip(ids, x)}
    assert all(len(v) == 10 for v in got.values())
    assert all(abs(s - np.sqrt(((place[q] - place[i]) ** 2).sum())) < 1e-12 for q, v in got.items() for i, s in v)


def test_clusters_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    monkeypatch.setattr(neighbours, "OCCUPANCY", 20)
    draw = np.random.RandomState(3)
    x = np.repeat(draw.normal(size=(30, 16)), 40, axis=0) + 0.05 * draw.normal(size=(1200, 16))
    x[:400] = x[0]  # a third are the same
    ids = draw.permutation(1200)
    df = table(spark, ids, x)
    vectors = neighbours.usable(df)
    plan = neighbours.plan_for(vectors, 1200)
    assert plan.directions >= 2
    got, want = found(neighbours.report(df)), exact(ids, x)
    assert recall(got, want) >= 0.9
    assert all(got[int(i)] == [(j, 0.0) for j in sorted(ids[:400]) if j != i][:10] for i in ids[:400] if i % 100 == 0)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 1.0], 2), (2, None, 3), (3, [0.0, 0.0], 4), (4, [float("nan"), 1.0], 5), (5, [float("inf"), 1.0], 6),
        (6, [None, 1.0], 7), (None, [1.0, 0.0], 8), (7, [1.0, 0.0, 0.0], 9), (1, [1.0, 3.0], 10), (1, [1.0, 1.0], 11), (100, [], 12),
        (200, [0.0, 2.0], 13), (8, [1.0, 1.0], 14),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = found(neighbours.report(df))
    assert got == {0: [(1, 1.0), (8, 1.0), (200, 5**0.5)], 200: [(1, 2**0.5), (8, 2**0.5), (0, 5**0.5)]}
    assert neighbours.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("place", [[0.5], [0.1, 3.9], [2.2, -1.3, 0.0]])
def test_probes_come_in_order_and_reach_the_chance(place):
    def chance(cells, reach):
        return np.prod([neighbours._normal((c + 1 - p) / reach) - neighbours._normal((c - p) / reach) for c, p in zip(cells, place)])

    got = neighbours.probes(np.array(place), 0.8, 0.9)
    values = [chance(c, 0.8) for c in got]
    assert len(set(got)) == len(got) and values == sorted(values, reverse=True)
    assert sum(values) >= 0.9 > sum(values[:-1])


def nearest_rows(ids, x, nearest=10):
    out = {}
    for at in np.flatnonzero(ids % 100 == 0):
        best = out.setdefault(int(ids[at]), {})
        for i, d in zip(ids.tolist(), np.sqrt(((x - x[at]) ** 2).sum(1)).tolist()):
            if i != ids[at]:
                best[i] = min(d, best.get(i, d))
    return {q: sorted(best.items(), key=lambda b: (b[1], b[0]))[:nearest] for q, best in out.items()}


@pytest.mark.parametrize("often", [100, 7])
def test_rows_of_one_id_are_dealt(spark, monkeypatch, often):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 16)
    real = neighbours._nearest

    def watched(nearest):
        def near(index, asked):
            assert len(index) <= 128 and len(asked) <= 48
            return real(nearest)(index, asked)
        return near

    monkeypatch.setattr(neighbours, "_nearest", watched)
    draw = np.random.RandomState(4)
    x = draw.normal(size=(600, 8))
    ids = np.r_[np.full(300, often), 1000 + np.arange(300)]
    x[-1] = x[0]  # id 1299, beside a row of the frequent id
    got = found(neighbours.report(table(spark, ids, x)))
    want = nearest_rows(ids, x)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-9 for q in want for (_, a), (_, b) in zip(got[q], want[q]))


def test_one_id_does_not_push_out_the_others(spark):
    x = np.r_[np.full((40, 2), 1.0), np.arange(2, 26, dtype=float).reshape(12, 2)]
    ids = np.r_[100, np.full(39, 1), 2 + np.arange(12)]
    vectors = neighbours.usable(table(spark, ids, x))
    whole = neighbours.Plan(0, 1.0, 1.0, 1, 1.0)
    assert found(neighbours.search(vectors, vectors.filter("id = 100"), plan=whole)) == nearest_rows(ids, x)
