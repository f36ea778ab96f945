import zlib

import numpy as np

from mendwell.llm import quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.report(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows} == {True}
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_scores_are_sums_of_looked_up_values_and_repeat():
    draw = np.random.RandomState(2)
    x = draw.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # nothing but a pair explains it
    model, again = quality.train(x, y), quality.train(x, y)
    assert np.array_equal(model.score(x), again.score(x))
    assert np.mean((model.score(x) > 0.5) == y) > 0.9
    for row, score in zip(x[:50], model.score(x[:50])):
        total = model.base + sum(t[sum(row[j] >= e)] for j, (e, t) in enumerate(zip(model.edges, model.tables)) for e in [e])
        total += sum(t[(row[i] >= model.pair_edges[i]).sum(), (row[j] >= model.pair_edges[j]).sum()] for i, j, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (8, 1, 0), (9, None, None), (None, 1, 1), (10, 1, 0), (13, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality.report(odd_docs, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    none = quality.report(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.keep_good(odd_docs, labels.limit(0)).columns == odd_docs.columns
    assert quality.report(no_docs, labels).count() == 0


def test_features_of_odd_texts():
    for text in (None, "", " \n", "a", "😀" * 1000, "A!! " * 100_000):
        got = quality.features(text)
        assert len(got) == len(quality.FEATURES) and np.isfinite(got).all()


def plain_train(x, y):
    """Cyclic boosting row by row, every cut tried; returns the score of each row."""
    rows, features, fit = range(len(y)), range(len(x[0])), [i % 7 != 6 for i in range(len(y))]

    def edges(j, bins):
        return sorted(set(np.quantile([r[j] for r in x], [k / bins for k in range(1, bins)])))

    def bin_of(value, cuts):
        return sum(c <= value for c in cuts)

    def cut(g, h):
        best = (0.0, 0)
        for at in range(1, len(g)):
            parts = [(g[:at], h[:at]), (g[at:], h[at:])]
            won = sum(sum(a) ** 2 / (sum(b) + quality.RIDGE) for a, b in parts) - sum(g) ** 2 / (sum(h) + quality.RIDGE)
            best = (won, at) if at == 1 or won > best[0] else best
        return best

    def leaf(g, h):
        return quality.RATE * sum(g) / (sum(h) + quality.RIDGE)

    def tree(g, h):
        first = cut(g, h)[1]
        marks = {0, first, len(g)}
        for a, b in ((0, first), (first, len(g))):
            if b - a > 1:
                marks.add(a + cut(g[a:b], h[a:b])[1])
        marks = sorted(marks)
        return [leaf(g[a:b], h[a:b]) for a, b in zip(marks, marks[1:]) for _ in range(a, b)]

    def pair_tree(g, h):
        best = None
        for turned in (False, True):
            gg, hh = ([list(z) for z in zip(*t)] if turned else t for t in (g, h))
            at = cut([sum(r) for r in gg], [sum(r) for r in hh])[1]
            step, won = [[0.0] * len(gg[0]) for _ in gg], 0.0
            for part in (range(at), range(at, len(gg))):
                columns = range(len(gg[0]))
                got, place = cut([sum(gg[r][c] for r in part) for c in columns], [sum(hh[r][c] for r in part) for c in columns])
                won += got
                for side in (columns[:place], columns[place:]):
                    value = leaf([gg[r][c] for r in part for c in side], [hh[r][c] for r in part for c in side])
                    for r in part:
                        for c in side:
                            step[r][c] = value
            if best is None or won > best[0]:
                best = won, [list(z) for z in zip(*step)] if turned else step
        return best[1]

    total = [float(np.log((sum(y) + 1) / (len(y) - sum(y) + 1)))] * len(y)

    def slope(i):
        p = 1 / (1 + np.exp(-total[i]))
        return (y[i] - p, p * (1 - p)) if fit[i] else (0.0, 0.0)

    def loss():
        held = [i for i in rows if not fit[i]]
        ps = {i: min(max(1 / (1 + np.exp(-total[i])), 1e-9), 1 - 1e-9) for i in held}
        return -sum(y[i] * np.log(ps[i]) + (1 - y[i]) * np.log(1 - ps[i]) for i in held) / len(held)

    def rounds(most, turn):
        nonlocal total
        least, kept, waited = loss(), list(total), 0
        for _ in range(most):
            turn()
            now = loss()
            if now < least - 1e-6:
                least, kept, waited = now, list(total), 0
            else:
                waited += 1
                if waited >= quality.PATIENCE:
                    break
        total = kept

    bins = {j: [bin_of(r[j], edges(j, quality.BINS)) for r in x] for j in features}
    sizes = {j: len(edges(j, quality.BINS)) + 1 for j in features}
    coarse = {j: [bin_of(r[j], edges(j, quality.PAIR_BINS)) for r in x] for j in features}
    wide = {j: len(edges(j, quality.PAIR_BINS)) + 1 for j in features}

    def mains():
        for j in features:
            g, h = [0.0] * sizes[j], [0.0] * sizes[j]
            for i in rows:
                a, b = slope(i)
                g[bins[j][i]] += a
                h[bins[j][i]] += b
            step = tree(g, h)
            for i in rows:
                total[i] += step[bins[j][i]]

    def table(i, j):
        g, h = ([[0.0] * wide[j] for _ in range(wide[i])] for _ in range(2))
        for r in rows:
            a, b = slope(r)
            g[coarse[i][r]][coarse[j][r]] += a
            h[coarse[i][r]][coarse[j][r]] += b
        return g, h

    rounds(quality.ROUNDS, mains)
    ranked = []
    for i in features:
        for j in range(i + 1, len(features)):
            g, h = table(i, j)
            ranked.append((sum(s * a for one, two in zip(pair_tree(g, h), g) for s, a in zip(one, two)), i, j))
    chosen = sorted(ranked, reverse=True)[:quality.PAIRS]

    def twos():
        for _, i, j in chosen:
            step = pair_tree(*table(i, j))
            for r in rows:
                total[r] += step[coarse[i][r]][coarse[j][r]]

    rounds(quality.PAIR_ROUNDS, twos)
    return [1 / (1 + np.exp(-t)) for t in total]


def test_training_equals_boosting_row_by_row(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 25)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 12)
    draw = np.random.RandomState(7)
    for size in (40, 75):
        x = draw.normal(size=(size, 3))
        y = ((x[:, 0] + x[:, 1] * x[:, 2] + draw.normal(scale=0.3, size=size)) > 0).astype(float)
        assert np.allclose(quality.train(x, y).score(x), plain_train(x.tolist(), y.tolist()), atol=1e-9)


def test_keeping_good_rows_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 20)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(odd_docs, labels)
    good = {(r.doc_id, r.predicted) for r in quality.report(odd_docs, labels).collect()}
    assert kept.columns == odd_docs.columns and {(r.doc_id, 1) for r in kept.select("doc_id").collect()} == {g for g in good if g[1] == 1}
    assert quality.keep_good(no_docs, labels).count() == 0
    assert quality.keep_good(odd_docs, labels.limit(0)).count() == odd_docs.count()  # without labels nothing is rejected
