import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameprobe.llm import neighbours


def brute(rows, k, modulus):
    """For every query row, by place in the list: (distance, id) of the k nearest others."""
    def fine(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    rows = [(i, v) for i, v in rows if i is not None and fine(v)]
    out = []
    for n, (i, v) in enumerate(rows):
        if i % modulus == 0:
            near = sorted((math.dist(v, w), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v))
            out.append((i, near[:k]))
    return out


def results(df):
    """Rows of each query id; a repeated id gives its lists one after another by rank."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"], r.score, r.vec_id)):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def clustered(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dim))


def table(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in rows], f"vec_id long, embedding {kind}, id string, i int").repartition(3)


@pytest.mark.parametrize("rows_at_once", [8192, 7])
def test_every_cell_visited_is_exact(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", rows_at_once)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 20)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(120, 5))]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # copies beyond k + 1
    rows += [(300, rows[3][1]), (310, rows[3][1]), (310, [1.0, 2.0, 3.0, 4.0, 5.0]), (310, [1.0, 2.0, 3.0, 4.0, 5.0])]
    rows += [(400, None), (410, []), (420, [0.0] * 5), (430, [1.0, None, 1.0, 1.0, 1.0]), (440, [float("nan")] + [1.0] * 4),
             (450, [float("inf")] + [1.0] * 4), (None, [1.0] * 5), (460, [1.0]), (470, [2.0]), (481, [4.0]), (490, [1.0, 1.0]),
             (500, [1e200] * 5), (510, [-1e200] * 5), (521, [1e-200, 0.0, 0.0, 0.0, -0.0]), (530, [2e-200, 0.0, 0.0, 0.0, 0.0])]
    got = results(neighbours.nearest(table(spark, rows), F.col("vec_id") % 10 == 0, 10, reach=1.0))
    want = {}
    for i, near in brute(rows, 10, 10):
        want.setdefault(i, []).extend((n, j, d) for n, (d, j) in enumerate(near, 1))
    want = {i: sorted(x, key=lambda r: (r[0], r[2], r[1])) for i, x in want.items() if x}
    assert got.keys() == want.keys()
    for i in want:
        assert [r[:2] for r in got[i]] == [r[:2] for r in want[i]], i
        assert [r[2] for r in got[i]] == pytest.approx([r[2] for r in want[i]], rel=1e-12)


@pytest.mark.parametrize("make", [lambda n: clustered(n), lambda n: np.random.default_rng(3).normal(size=(n, 16))])
def test_recall_against_brute_force(spark, monkeypatch, make):
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 800)
    values = make(3000)
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    got = results(neighbours.nearest(table(spark, rows), F.col("vec_id") % 100 == 0))
    hits = 0
    for i in range(0, 3000, 100):
        d = np.sqrt(((values - values[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [r[0] for r in got[i]] == list(range(1, 11))
        assert [r[2] for r in got[i]] == pytest.approx([d[r[1]] for r in got[i]], rel=1e-12)
        hits += len({r[1] for r in got[i]} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 300


def test_walk_goes_by_summed_distance():
    values = clustered(400, 6)
    book = neighbours.Codebook.fitted(values, 400, 10, 0.9)
    counts = np.zeros((len(book.first), len(book.second)), np.int64)
    np.add.at(counts, book.cells(values), 1)
    one, two = book._halves(values[:5])
    for n, cells in enumerate(book.visits(values[:5], counts, 1e9)):
        sums = [one[n, i] + two[n, j] for i, j in cells]
        assert sums == sorted(sums) and len(set(cells)) == (counts > 0).sum()
    few = next(book.visits(values[:1], counts, 50))
    assert sum(counts[c] for c in few) >= 50 > sum(counts[c] for c in few[:-1])


def test_heap_and_sort_give_one_walk():
    rng = np.random.default_rng(5)
    for n, m in [(1, 1), (1, 7), (9, 1), (16, 12), (32, 32)]:
        near, far = (np.sort(rng.integers(0, 9, size)).astype(float) for size in (n, m))  # many equal sums
        held = rng.integers(0, 3, (n, m))
        for wanted in (1, held.sum() // 3, held.sum(), held.sum() + 5):
            one, two = (np.stack(f(near, far, held, wanted)) for f in (neighbours._popped, neighbours._sorted))
            assert one.tolist() == two.tolist()


def test_groups_hold_all_buckets_and_few_entries(monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 50)
    monkeypatch.setattr(neighbours, "GROUPS", 4)
    counts = np.zeros((12, 3), np.int64)
    counts[:, 1] = [0, 9, 10, 0, 30, 5, 120, 0, 0, 8, 8, 0]
    groups = neighbours.Groups.fitted(counts)
    assert groups.begins[0] == 0 and groups.begins[-1] == 12 and (np.diff(groups.begins) > 0).all() and groups.width == 3
    for a, b, parts in zip(groups.begins, groups.begins[1:], groups.parts):
        held = counts[a:b].sum()
        assert parts == 1 + held // 50 and (held <= 50 or (counts[a:b].sum(axis=1) > 0).sum() == 1)
        assert {groups.of(i) for i in range(a, b)} == {groups.begins.tolist().index(a)}
    counts[:, 1] = 1
    assert neighbours.Groups.fitted(counts).parts == [1] * 4


def test_query_blocks_are_never_broadcast(spark, monkeypatch):
    """They outgrow the driver: Spark takes their size for that of the queries before these are copied to the groups."""
    monkeypatch.setattr(neighbours, "REMEMBERED", 2, raising=False)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(1200))]
    found = neighbours.nearest(table(spark, rows, "array<float>"), F.col("vec_id") % 3 == 0, reach=1.0)
    got = results(found)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan.split("Initial Plan")[0]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    assert {i: [r[1] for r in x] for i, x in got.items()} == {i: [j for _, j in near] for i, near in brute(rows, 10, 3)}


def test_table_without_rows(spark):
    assert neighbours.nearest(table(spark, [(1, [1.0])]).limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(table(spark, [(0, [1])], "array<int>"), F.lit(True)).count() == 0
