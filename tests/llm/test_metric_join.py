import math

import numpy as np
import pytest

from lumisheet.llm import metric_join


def brute(rows, cosine=0.93):
    """vec_id: (n_links, component_id) of rows (id, vector, label); ids unique."""
    ok = [v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    parent = {i: i for i, _, _ in rows}
    links = dict.fromkeys(parent, 0)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, v, lab) in enumerate(rows):
        for j in range(i):
            b, w, other = rows[j]
            if ok[i] and ok[j] and lab == other and len(v) == len(w):
                p, q = np.float64(v), np.float64(w)
                if p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {a: (links[a], find(a)) for a, _, _ in rows}


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_duplicates(df, **options).collect()}
    assert got == brute(rows)


def cloud(seed, dims, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    x = centres[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, dims))
    x *= rng.uniform(0.1, 9, (n, 1))
    return [(int(i), [float(np.float32(c)) for c in v], int(k)) for i, v, k in zip(rng.permutation(n), x, rng.integers(0, 2, n), strict=True)]


@pytest.mark.parametrize(("dims", "spread", "options"), [(3, 0.25, dict(cell_rows=20, block_rows=16)), (16, 0.25, dict(cell_rows=20, block_rows=1000)), (16, 0.3, {}), (2, 0.1, dict(cell_rows=10, block_rows=7, max_pivots=6)), (16, 0.25, dict(cell_rows=20, wide_rows=10, block_rows=30)),
    (3, 0.25, dict(cell_rows=8, wide_rows=16, block_rows=40, max_pivots=4)), (16, 0.3, dict(cell_rows=8, wide_rows=16, block_rows=16, max_pivots=4)), (2, 0.3, dict(cell_rows=4, wide_rows=8, block_rows=16, max_pivots=1))])
def test_against_all_pairs(spark, dims, spread, options):
    check(spark, cloud(dims, dims, 300, spread), **options)


def test_odd_vectors(spark):
    rows = [
        (1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [math.nan, 1.0], 0), (5, [math.inf, 1.0], 0), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 0), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0),
        (10, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 0), (12, [], 0), (13, [-1.0, 0.0], 0), (14, [3e38, 3e37], 0), (15, [1e-38, 1e-39], 0),
    ]
    check(spark, rows)
    check(spark, rows, cell_rows=2, block_rows=2)


def test_repeated_rows_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, "x")] * 3 + [(2, [1.0, 2.0], 0, "y")], "vec_id long, embedding array<float>, label int, cid string")
    rows = metric_join.digest(df).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in sorted(rows)] == [(1, 3, 1, True)] * 3 + [(2, 3, 1, False)]
    assert metric_join.digest(df.where("1 = 0")).count() == 0


def test_cells_hold_all_partners():
    """Every vector within the radius is in the home cell or in a visited one, with and without the radii of the cells."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5))
    x = np.concatenate((x, x[:100] + 0.1 * rng.normal(size=(100, 5))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots, radius = x[:30], 0.37
    apart = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))
    home = apart.argmin(axis=1)
    reach = np.array([apart[home == q, q].max(initial=0) for q in range(30)])
    partners = np.linalg.norm(x[:, None] - x[None], axis=2) <= radius
    for r in (None, reach):
        got, cells = metric_join.visited(x, pivots, radius, r)
        assert (got == home).all() and cells.mean() < 0.5
        cells[np.arange(len(x)), home] = True
        assert all(cells[i, home[j]] for i, j in zip(*np.nonzero(partners), strict=True))


def test_vectors_without_id(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 0), (4, [1.0, 0.1], 0), (3, [1.0, 0.2], 0), (None, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in metric_join.digest(df).collect()), key=str) == sorted([(None, 2, 3), (4, 2, 3), (3, 2, 3), (None, 0, None)], key=str)


def test_further_levels_part_cells(spark):
    """Pivots of cells: fewer pairs are compared with each level, and a label without pivots of its own is served."""
    rows = [(0, 3, v, i, i, 1) for i, v, _ in cloud(9, 3, 600, 0.4)]
    classes = spark.createDataFrame(rows, "label int, dims int, v array<float>, cid long, id long, c long")
    members = metric_join.route(classes, 0.93, 8, 16, 4)
    pairs = [metric_join.compared(members).first().pairs]
    for level in (2, 3):
        members = metric_join._refined(members, 0.93, 8, 16, 40, 4, level)
        pairs.append(metric_join.compared(members).first().pairs)
        assert members.where("home").count() == 600
    assert pairs[2] < pairs[1] < pairs[0] < 600 * 599 / 2
    one = metric_join.route(classes, 0.93, 1 << 20, 16, 4)
    assert metric_join.compared(metric_join._refined(one, 0.93, 8, 16, 40, 64, 2)).first().pairs < pairs[0]
