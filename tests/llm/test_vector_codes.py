"""Codes of vectors against a plain version in Python's integers."""

import hashlib
import math
import random

from chatterlake.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, position int, id string"


def brute(rows, n_parts=8, n_entries=16, rounds=6):
    """rows: (vec_id, vector, label)."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    dims = len(order[0][1])
    rows, order = [r for r in rows if len(r[1]) == dims], [r for r in order if len(r[1]) == dims]
    width = max(-(-dims // n_parts), 1)

    def cut(vector):
        whole = [math.floor(4096 * x) for x in vector] + [0] * (n_parts * width - dims)
        return [tuple(whole[p * width : (p + 1) * width]) for p in range(n_parts)]

    seeds = [r for i, r in enumerate(order) if not i or r[0] != order[i - 1][0]][:n_entries]
    books = [[cut(r[1])[p] for r in seeds] for p in range(n_parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda part, book: min(range(len(book)), key=lambda e: (distance(part, book[e]), e))
    parts = [cut(r[1]) for r in rows]
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for x in parts:
                groups.setdefault(nearest(x[p], book), []).append(x[p])
            books[p] = [tuple(sum(c) // len(groups[e]) for c in zip(*groups[e])) if e in groups else entry for e, entry in enumerate(book)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, sums = [], {}
    for r, x in zip(rows, parts):
        codes = [nearest(x[p], books[p]) for p in range(n_parts)]
        error = sum(distance(x[p], books[p][c]) for p, c in enumerate(codes))
        sums[r[2]] = sums.get(r[2], 0) + error
        out.append((r[0], "".join(f"{c:02x}" for c in codes), min(error, 2**63 - 1), r[2]))
    return sorted(repr((*o[:3], min(sums[o[3]], 2**63 - 1), digest)) for o in out)


def vectors(n, dims, seed=3):
    rng = random.Random(seed)
    f = lambda: math.floor(rng.gauss(0, 0.3) * 64) / 64  # few values, so that prefixes repeat
    rows = [(i * 5 % (n + 3), [f() for _ in range(dims)], rng.choice([1, 2, 3, None])) for i in range(n)]
    return rows + [(r[0] + 1000, r[1], r[2]) for r in rows[: n // 3]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 4, "y") for r in rows], SCHEMA).repartition(3)


def result(df):
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in df.collect())


ODD = [
    (-9, None, 1), (-8, [0.1] * 15 + [None], 2), (-7, [0.2] * 15 + [float("nan")], 2), (-6, [float("inf")] + [0.0] * 15, 1),
    (None, [0.25] * 16, None), (None, [0.5] * 16, 7), (3, [0.5] * 16, 1), (3, [-0.5] * 16, 1), (900, [0.1] * 5, 1), (901, [], 1),
]


def test_equals_brute(spark):
    rows = vectors(300, 16) + ODD
    assert result(vector_codes.compress(frame(spark, rows))) == brute(rows)


def test_few_rows_and_widths(spark):
    for rows in (vectors(5, 16), vectors(40, 13), vectors(30, 3), [(1, [], None), (2, [], 3)], [(None, [1.0, 2.0], 1)]):
        assert result(vector_codes.compress(frame(spark, rows))) == brute(rows)


def test_other_sizes_of_codebooks(spark):
    rows = vectors(80, 16)
    assert result(vector_codes.compress(frame(spark, rows), n_parts=4, n_entries=3, rounds=2)) == brute(rows, 4, 3, 2)


def test_huge_components(spark):
    rows = vectors(60, 16) + [(i + 500, [(-1) ** i * 3e38 / (i + 1), 1e30, -7e20, 5e12] * 4, 1) for i in range(9)]
    rows = [(k, [float(spark_float(x)) for x in v], lab) for k, v, lab in rows]
    assert result(vector_codes.compress(frame(spark, rows))) == brute(rows)


def spark_float(x):
    import numpy as np

    return np.float32(x)


def test_no_rows(spark):
    assert result(vector_codes.compress(frame(spark, vectors(5, 16)).where("false"))) == []
    assert result(vector_codes.compress(frame(spark, ODD[:4]))) == []


def test_blocks_share_their_path(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    parts = np.unique(rng.integers(-3, 4, (5_000, 6)), axis=0)
    entries = rng.integers(-3, 4, (16, 6))
    whole = ((parts[:, None] - entries) ** 2).sum(2)
    for leaves in (1, 7, 4096):
        monkeypatch.setattr(vector_codes, "LEAVES", leaves)
        code, error = vector_codes.walked(parts, entries)
        assert (code == whole.argmin(1)).all() and (error == whole.min(1)).all()
