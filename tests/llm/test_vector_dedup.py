"""Links of vectors against all pairs."""

import math

import numpy as np
import pytest

from chatterlake.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, cell long, rep string, n string, component int"


def brute(rows, similarity=0.98):
    """n_links, component_id, kept of each row by all pairs."""
    fine = [
        r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
        for r in rows
    ]
    linked = [[] for _ in rows]
    groups = {}
    for i, r in enumerate(rows):
        if fine[i]:
            groups.setdefault((r[2], len(r[1])), []).append(i)
    for at in groups.values():
        x = np.array([rows[i][1] for i in at], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= similarity
        for a, i in enumerate(at):
            linked[i] = [at[b] for b in np.flatnonzero(near[a]) if b != a]
    component = list(range(len(rows)))
    out = [None] * len(rows)
    seen = set()
    for i in range(len(rows)):
        if i not in seen:
            group, todo = [], [i]
            seen.add(i)
            while todo:
                at = todo.pop()
                group.append(at)
                for other in linked[at]:
                    if other not in seen:
                        seen.add(other)
                        todo.append(other)
            for at in group:
                component[at] = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
    for i, r in enumerate(rows):
        own = component[i] if r[0] is not None else None
        out[i] = repr((r[0], len(linked[i]), own, r[0] is None or r[0] == own))
    return sorted(out)


def vectors(n, dims, seed=4, groups=(2, 3, 40), noise=0.1):
    rng = np.random.default_rng(seed)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.standard_normal(dims))
    rows = [(unit(), int(rng.integers(3))) for _ in range(n)]
    for size in groups:
        base, label = unit(), int(rng.integers(3))
        for _ in range(size):
            rows.append((base + noise * rng.uniform(0.2, 1.0) * unit(), label if rng.random() < 0.9 else 5))
    rows += [(2.5 * v, lab) for v, lab in rows[:3]] + [(v, lab) for v, lab in rows[3:9] for _ in range(4)]
    order = rng.permutation(len(rows))
    return [(int(3 * i + 1), np.float32(rows[j][0]).tolist(), rows[j][1]) for i, j in enumerate(order)]


ODD = [
    (9001, None, 1), (9002, [0.1] * 15 + [None], 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] * 16, 1), (9005, [0.0] * 16, 1), (9006, [], 1),
    (9007, [0.5] * 16, None), (9008, [0.5] * 16, None), (9009, [0.5] * 16, 1), (9010, [0.5] * 8, 1), (9011, [0.5] * 16, 1), (None, [0.5] * 16, 1),
    (9012, [3e38] * 16, 1), (9013, [1e-38] * 16, 1), (9001, [0.25] * 16, 1), (9014, [-0.5] * 16, 1),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x", "y", 2) for r in rows], SCHEMA).repartition(3)


def result(df):
    return sorted(repr((r.vec_id, r.n_links, r.component_id, r.kept)) for r in df.collect())


def test_equals_all_pairs(spark):
    rows = vectors(150, 16) + ODD
    assert result(vector_dedup.near_vectors(frame(spark, rows), recall=1.0)) == brute(rows)


@pytest.mark.parametrize("unit, cell_rows", [(4, 2), (16, 300)])
def test_large_cells_are_cut(spark, monkeypatch, unit, cell_rows):
    monkeypatch.setattr(vector_dedup, "UNIT_ROWS", unit)
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", cell_rows)
    rows = vectors(120, 8, seed=unit, groups=(30, 70), noise=0.3)
    assert result(vector_dedup.near_vectors(frame(spark, rows), recall=1.0)) == brute(rows)


def test_recall_at_the_threshold():
    """Pairs at the threshold, from other vectors than the grid was laid out with."""
    rng = np.random.default_rng(8)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.standard_normal((n, 64)))
    grid = vector_dedup.lay_out(unit(4_000), 20_000, 0.98, vector_dedup.RECALL)
    one, turn = unit(6_000), unit(6_000)
    turn -= (turn * one).sum(1)[:, None] * one
    two = 0.98 * one + math.sqrt(1 - 0.98**2) * turn / np.linalg.norm(turn, axis=1)[:, None]
    home, row, cell = grid.visits(np.concatenate([one, two]))
    met = set(zip(row.tolist(), cell.tolist()))
    n = len(one)
    found = sum(home[i] == home[n + i] or (i, home[n + i]) in met or (n + i, home[i]) in met for i in range(n))
    assert found >= 0.99 * n
    assert len(row) < 12 * len(home)


def test_visits_are_the_cells_within_the_margin():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 6))
    grid = vector_dedup.Grid(rng.standard_normal((7, 3)), rng.standard_normal((5, 3)), 1.5)
    left, right = grid.halves(x)
    home, row, cell = grid.visits(x)
    for i in range(len(x)):
        away = (left[i][:, None] + right[i][None]).reshape(-1)
        assert home[i] == away.argmin()
        want = {int(c) for c in np.flatnonzero(away <= away.min() + 1.5) if c > home[i]}
        assert set(cell[row == i].tolist()) == want and (row == i).sum() == len(want)


def test_no_rows(spark):
    assert result(vector_dedup.near_vectors(frame(spark, ODD).where("false"))) == []
    assert result(vector_dedup.near_vectors(frame(spark, ODD[:6]))) == brute(ODD[:6])
