"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import multiindex, partitions

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep string, cell int, w int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "r", 1, 2) for i, v in rows], SCHEMA)


def near_vectors(seed=0, n=400, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if k % 4 == 0 or not rows:
            v = rng.normal(size=dim)
        else:
            v = np.array(rows[int(rng.integers(0, len(rows)))][1]) + rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.1, 0.13])
            v = v * rng.choice([0.5, 1, 3])
        rows.append((k, v.astype(np.float32).tolist()))
    return rows


def odd_rows(dim=16):
    nan, inf = float("nan"), float("inf")
    return [(9000, None), (9001, [0.0] * dim), (9002, [nan] + [1.0] * (dim - 1)), (9003, [inf] + [1.0] * (dim - 1)), (9004, [None] + [1.0] * (dim - 1)), (9005, [1.0] * (dim - 1)), (9006, []), (None, [1.0] * dim)]


def test_links_and_components(spark):
    rows = near_vectors() + odd_rows()
    x = np.array([v for _, v in rows[:400]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(400, dtype=bool)
    comp = np.arange(400)
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], 400).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    got = {r["vec_id"]: r for r in multiindex.near_duplicates(table(spark, rows).repartition(5), members=16, queries=32, per_cell=4).collect()}
    assert len(got) == len(rows)
    for k in range(400):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (link[k].sum(), comp[k], comp[k] == k)
    for k in (9000, 9001, 9002, 9003, 9004, 9005, 9006):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, True)


def test_repeated_rows_and_empty_tables(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    got = multiindex.near_duplicates(table(spark, [(7, v), (5, v), (5, v), (6, [-1.0, 0, 0, 0])])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(5, 2, 5), (5, 2, 5), (6, 0, 6), (7, 2, 5)]
    assert multiindex.near_duplicates(table(spark, [])).count() == 0
    assert multiindex.near_duplicates(table(spark, [(1, None)])).count() == 1


def test_multi_sequence_visits_nearest_cells_first():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random((30, 7)), rng.random((30, 5))
    limit = rng.random(30) * 2.2 - 0.1
    seen = [[] for _ in limit]
    for rows, i, j, s in multiindex.multi_sequence(d1, d2, limit):
        for r, *cell in zip(rows.tolist(), i.tolist(), j.tolist(), s.tolist(), strict=True):
            seen[r].append(cell)
    assert min(map(len, seen)) == 0 and max(map(len, seen)) == 35
    for x, y, most, cells in zip(d1, d2, limit, seen, strict=True):
        assert all(a[2] <= b[2] for a, b in zip(cells, cells[1:], strict=False))
        assert sorted((i, j) for i, j, _ in cells) == list(zip(*(c.tolist() for c in np.nonzero(x[:, None] + y[None, :] <= most)), strict=True))


def test_recall_of_links_at_the_threshold():
    """Pairs turned by about the linking angle, the hardest there are, among vectors without structure."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(rng.normal(size=(4000, 64)))
    turn = rng.normal(size=x.shape)
    turn = unit(turn - (turn * x).sum(axis=1)[:, None] * x)
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * turn
    index = multiindex.MultiIndex(x, 0.9, 0.999, 24)
    found = np.zeros(len(x), bool)
    for a, b in ((x, y), (y, x)):
        d1, d2 = index.distances(a)
        i, j = index.cells(*index.distances(b))
        for rows, p, q, _ in multiindex.multi_sequence(d1, d2, index.limits(d1, d2)):
            found[rows[(p == i[rows]) & (q == j[rows])]] = True
    assert found.mean() > 0.9995


def brute_search(rows, k):
    x, ids = np.array([v for _, v in rows], np.float64), np.array([i for i, _ in rows])
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[q])] = [(int(ids[b]), float(s[b])) for b in best]
    return out


@pytest.mark.parametrize("dim, n", [(4, 3000), (16, 600), (3, 15)])
def test_search(spark, dim, n):
    rng = np.random.default_rng(dim)
    rows = [(k, (rng.normal(size=dim) * rng.choice([1, 2])).astype(np.float32).tolist()) for k in range(n)]
    got = {}
    for r in partitions.search(table(spark, rows + odd_rows(dim)).repartition(4), F.col("vec_id") % 20 == 0, block=256).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_search(rows, 20)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(mine, mine[1:], strict=False))
        hits += len({m[1] for m in mine} & {b[0] for b in best}) / max(1, len(best))
        x = dict(rows)
        assert all(np.isclose(s, np.dot(np.float64(x[q]), np.float64(x[v]))) for _, v, s in mine)
    assert hits / len(want) >= 0.9


def test_search_with_many_equal_vectors(spark):
    rows = [(k, [1.0, 0.0, 0.0]) for k in range(100)] + [(k, [0.5, float(k), 0.0]) for k in range(100, 130)]
    got = {}
    for r in partitions.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert [v for _, v in sorted(got[0])] == [1, 2, 3, 4, 5]
    assert [v for _, v in sorted(got[40])] == [0, 1, 2, 3, 4]
    assert [v for _, v in sorted(got[120])] == [129, 128, 127, 126, 125]
    assert partitions.search(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert partitions.search(table(spark, [(20, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_partition_is_balanced_and_cuts_few_edges():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(100, 5)) * 0.1 + 3 * rng.normal(size=5) for _ in range(8)])
    graph = partitions.neighbour_graph(x, 5)
    label = partitions.balanced_partition(x, graph, 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= np.ceil(100 * 1.1) + 1
    assert (label[graph] == label[:, None]).mean() > 0.6
