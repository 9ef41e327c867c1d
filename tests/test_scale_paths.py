"""Bucketed and blocked paths against brute force, on data with hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldseries.operators import tomek
from fieldseries.operators.forecast import ar_forecast
from fieldseries.operators.materialize import materialize
from fieldseries.operators.metrics import ranking_metrics, roc_points
from fieldseries.operators.ranked import exact_quantiles
from fieldseries.operators.thresholds import search_rain_threshold, search_threshold
from fieldseries.operators.tomek import build_tree, bundles, nearest_neighbors, remove_tomek_links, tomek_links


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one group and one value; one group is null."""
    rng = np.random.default_rng(7)
    n = 3000
    group = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 5, n))
    score = np.where(rng.random(n) < 0.3, 0.5, np.round(rng.random(n), 3))
    pdf = pd.DataFrame({"g": group.astype(float), "y_score": score, "y_true": (rng.random(n) < 0.3 + 0.3 * score).astype(int)})
    pdf.loc[pdf.g == 4, "g"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("g", F.when(~F.isnan("g"), F.col("g").cast("int")))
    return df, pdf


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def brute_ap(y, s):
    total, last = 0.0, 0.0
    for t in np.unique(s)[::-1]:
        hit = s >= t
        recall = y[hit].sum() / y.sum()
        total += (recall - last) * y[hit].mean()
        last = recall
    return total


@pytest.mark.parametrize("bucketing", [{}, {"ranges": 40}, {"ranges": 300}])
def test_ranking_metrics_and_quantiles(skewed, bucketing):
    df, pdf = skewed
    got = {r.g: r for r in ranking_metrics(df, by=["g"], **bucketing).collect()}
    assert len(got) == 5
    quantiles = {(r.g, r.q_index): r["quantile"] for r in exact_quantiles(df, "y_score", [0.1, 0.5, 0.93], ["g"], **bucketing).collect()}
    even = {(r.g, r.q_index): r["quantile"] for r in exact_quantiles(df, "y_score", 400, ["g"], **bucketing).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        key = None if np.isnan(g) else int(g)
        y, s = part.y_true.to_numpy(), part.y_score.to_numpy()
        assert got[key].roc_auc == pytest.approx(brute_auc(y, s), abs=1e-12)
        assert got[key].pr_auc == pytest.approx(brute_ap(y, s), abs=1e-12)
        assert [quantiles[key, i] for i in range(3)] == list(np.quantile(s, [0.1, 0.5, 0.93]))
        assert [even[key, i] for i in range(400)] == list(np.quantile(s, np.linspace(0, 1, 400)))


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y_true int, y_score double")
    row = ranking_metrics(df).collect()[0]
    assert row.roc_auc is None and row.pr_auc is None and roc_points(df).count() == 0


def _best(y, s, candidates, key):
    rows = []
    for t in candidates:
        p = s >= t
        tp, fp, fn = int((p & (y == 1)).sum()), int((p & (y == 0)).sum()), int((~p & (y == 1)).sum())
        precision = tp / (tp + fp) if tp + fp else 0.0
        recall = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        rows.append((t, precision, recall, f1))
    return max(rows, key=lambda r: key(*r))


@pytest.mark.parametrize("bucketing", [{}, {"ranges": 64}])
def test_threshold_searches(skewed, bucketing):
    df, pdf = skewed

    def by_floor(t, precision, recall, f1):
        return (1, recall, precision, f1, -t) if precision >= 0.6 else (0, precision, recall, f1, -t)

    got = {r.g: r for r in search_threshold(df, by=["g"], **bucketing).collect()}
    rain = {r.g: r for r in search_rain_threshold(df, by=["g"], **bucketing).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        key = None if np.isnan(g) else int(g)
        y, s = part.y_true.to_numpy(), part.y_score.to_numpy()
        unique = np.unique(np.round(s, 10))
        if unique.size > 400:
            unique = np.quantile(s, np.linspace(0, 1, 400))
        best = _best(y, s, np.unique(np.append(unique, 0.5)), by_floor)
        assert (got[key].threshold, got[key].precision, got[key].recall) == best[:3]
        grid = np.unique(np.concatenate([np.linspace(0.05, 0.95, 19), np.round(s, 8)]))
        best = _best(y, s, grid, lambda t, p, r, f: (f, p, r, -t))
        assert (rain[key].threshold, rain[key].f1) == (best[0], best[3])


def _brute_neighbors(ids, x):
    d = np.round(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1), 9)
    np.fill_diagonal(d, np.inf)
    return np.array([ids[np.lexsort((ids, row))[0]] for row in d])


@pytest.mark.parametrize("blocks", [(4096, 8192), (16, 10), (7, 3)])
def test_nearest_neighbors_are_exact(spark, blocks):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(120, 3)), rng.normal(size=(60, 3)) * 0.01])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "_id long, _x array<double>")
    got = {r._id: r._nn for r in nearest_neighbors(df, *blocks).collect()}
    assert got == dict(zip(ids.tolist(), _brute_neighbors(ids, x).tolist()))


def test_ball_tree_prunes_clustered_data(spark):
    """64 dimensions in 16 clusters: exact, and fewer than half of all leaf pairs are visited."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(16, 64)) * 10
    x = np.concatenate([c + rng.normal(size=(60, 64)) for c in centres])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "_id long, _x array<double>")
    report = {}
    got = {r._id: r._nn for r in nearest_neighbors(df, 40, 100, report=report).collect()}
    assert got == dict(zip(ids.tolist(), _brute_neighbors(ids, x).tolist()))
    share = report["pairs"] / (report["leaves"] * (report["leaves"] - 1))
    assert report["leaves"] >= 24 and share < 0.5, report


def test_ball_tree_of_outliers_stays_shallow(spark):
    """Each row is far beyond the next: splits at the nearer pivot take one row at a time."""
    x = np.concatenate([[[3.0**k, 0.0] for k in range(150)], [[0.0, float(k % 7)] for k in range(1, 8)]])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "_id long, _x array<double>")
    for leaf_rows, task_rows in ((2, 1000), (40, 1)):
        pts, nodes = build_tree(df, leaf_rows, task_rows)
        sizes = [r["count"] for r in pts.groupBy("_node").count().collect()]
        assert sum(sizes) == len(x) and max(sizes) <= leaf_rows and max(r._node for r in pts.collect()) < 2**24
        assert nodes.where("_node = 1").first()._n == len(x)


def test_rows_travel_once_for_each_bundle(spark):
    """Small bundles meet in pairs, each visits the other: exact, with ties on a grid."""
    x = np.array([[float(a), float(b), float(a * b % 5)] for a in range(12) for b in range(12)])
    ids = np.random.default_rng(2).permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "_id long, _x array<double>")
    expected = dict(zip(ids.tolist(), _brute_neighbors(ids, x).tolist()))
    for rows in (40, None):
        assert {r._id: r._nn for r in nearest_neighbors(df, 5, 7, bundle_rows=rows).collect()} == expected, rows


def test_rows_travel_as_often_in_a_larger_table(spark, monkeypatch):
    """Six times the rows make about as many bundles: shuffled rows grow with the table, not with its square."""
    named, rng = [], np.random.default_rng(4)
    monkeypatch.setattr(tomek, "bundles", lambda nodes, rows: named.append(out := bundles(nodes, rows)) or out)
    for n in (7000, 42_000):
        df = spark.createDataFrame([(i, row) for i, row in enumerate(rng.normal(size=(n, 2)).tolist())], "_id long, _x array<double>")
        assert nearest_neighbors(df).count() == n
    small, large = (d.select("_bundle").distinct().count() for d in named)
    assert 6 <= small <= 16 and 6 <= large <= 16, (small, large)


def test_tomek_with_many_copies(spark):
    """A third of the rows are copies of one vector."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros((60, 2)), np.round(rng.normal(size=(120, 2)), 1)])
    ids, y = np.arange(len(x)), (rng.random(len(x)) < 0.4).astype(int)
    df = spark.createDataFrame([(int(i), [float(v) for v in r], int(c)) for i, r, c in zip(ids, x, y)], "id long, x array<double>, y int")
    near = _brute_neighbors(ids, x)
    expected = {int(i) for i in ids if near[near[i]] == i and y[near[i]] != y[i]}
    assert {r.id for r in tomek_links(df, "x", "y", "id", 16, 10).collect()} == expected
    majority = 1 if y.sum() >= len(y) - y.sum() else 0
    kept = {r.id for r in remove_tomek_links(df, "x", "y", "id", block_rows=16, visitor_rows=10).collect()}
    assert kept == {int(i) for i in ids if not (i in expected and y[i] == majority)}


def test_autoregression_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(60) < 0.5).astype(int)
    rows = [(1, i, int(v), "train" if i < 40 else "validation" if i < 50 else "test") for i, v in enumerate(y)]
    rows += [(2, i, 0, "train" if i < 5 else "test") for i in range(8)]
    df = spark.createDataFrame(rows, "site int, t int, y int, split string")
    got = {(r.site, r.t): r.y_score for r in ar_forecast(df, ["site"], ["t"], "y", 2, 5).collect()}
    train, lags = y[:40].astype(float), [1, 2, 5]
    a = np.stack([train[5 - k : 40 - k] for k in lags], axis=1)
    beta = np.linalg.lstsq(a, train[5:], rcond=None)[0]
    values = list(train)
    for _ in range(20):
        values.append(sum(b * values[-k] for b, k in zip(beta, lags)))
    assert [got[1, t] for t in range(40, 60)] == pytest.approx(np.clip(values[40:], 0, 1).tolist(), abs=1e-9)
    # a constant short series has no fit: the training mean answers
    assert [got[2, t] for t in range(5, 8)] == [0.0, 0.0, 0.0]


def test_pairs_of_leaves_are_not_written(spark, monkeypatch):
    """No pruning in 12 dimensions: nearly all pairs of 250 leaves meet, and tables stay in proportion to the rows."""
    written = []
    monkeypatch.setattr(tomek, "materialize", lambda df: written.append(out := materialize(df)) or out)
    sizes = {}
    monkeypatch.setattr(tomek, "discard", lambda *old: sizes.update({id(x): x.count() for x in old}))
    rows = np.random.default_rng(6).normal(size=(2000, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, row) for i, row in enumerate(rows.tolist())], "_id long, _x array<float>")
    report = {}
    got = {r._id: r._nn for r in nearest_neighbors(df, 8, 64, report=report, bundle_rows=600).collect()}
    assert got == dict(enumerate(_brute_neighbors(np.arange(2000), rows.astype(float)).tolist()))
    assert report["leaves"] > 200 and report["pairs"] > 20_000, report
    sizes.update({id(x): x.count() for x in written})
    assert max(sizes.values()) <= 4000, sorted(sizes.values())[-5:]


def test_bundles_meet_in_rounds(spark, monkeypatch):
    """Each pair of bundles meets in one of many rounds, and a round ships a bounded share of the rows."""
    monkeypatch.setattr(tomek, "ROUND_COPIES", 1)
    monkeypatch.setattr(tomek, "ROUND_ROWS", 1)
    shipped, sides = [], tomek._sides
    monkeypatch.setattr(tomek, "_sides", lambda met: shipped.append(met) or sides(met))
    x = np.random.default_rng(7).normal(size=(900, 8))
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "_id long, _x array<double>")
    got = {r._id: r._nn for r in nearest_neighbors(df, 30, 50, bundle_rows=200).collect()}
    assert got == dict(enumerate(_brute_neighbors(np.arange(900), x).tolist()))
    every, *rounds = [{(r._one, r._two) for r in met.select("_one", "_two").collect()} for met in shipped[1:]]
    assert len(rounds) >= 3 and sum(map(len, rounds)) == len(every) and set().union(*rounds) == every
    assert max(map(len, rounds)) <= len(every) / 2
