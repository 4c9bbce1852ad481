import math
import random

import numpy as np
import pytest

from maskweave.llm import grid_codes as gc

SCHEMA = "vec_id long, embedding array<double>, label int, part int, id int, error int"


def brute(rows):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 8))
    ints = [[math.floor(4096 * x) for x in v] + [0] * (8 * width - len(v)) for _, v, _ in kept]
    part = lambda e, p: e[p * width : (p + 1) * width]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[part(ints[k], p) for k in order[:16]] for p in range(8)]
    near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e)), i) for i, e in enumerate(b))
    for _ in range(6):
        new = []
        for p in range(8):
            groups = {}
            for e in ints:
                groups.setdefault(near(part(e, p), books[p])[1], []).append(part(e, p))
            new.append([[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else b for i, b in enumerate(books[p])])
        books = new
    out, labels = [], {}
    for (i, _, lab), e in zip(kept, ints):
        found = [near(part(e, p), books[p]) for p in range(8)]
        out.append((i, "".join(f"{c:02x}" for _, c in found), sum(d for d, _ in found), lab))
        labels[lab] = labels.get(lab, 0) + out[-1][2]
    import hashlib

    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[lab], sha) for i, c, e, lab in out), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA).repartition(3)


def check(spark, rows):
    got = sorted((tuple(r) for r in gc.compress_vectors(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i * 7 % 211, [rng.gauss(0, 0.15) for _ in range(24)], rng.choice([None, 0, 1, 2])) for i in range(200)]
    rows += [(500 + i, rows[i][1], 0) for i in range(40)]  # equal vectors
    rows += [(600 + i, [rng.choice([-0.001, 0.0, 0.001]) for _ in range(24)], 5) for i in range(60)]  # ties
    check(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(4)
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [nan] * 8, 1), (4, [inf] * 8, 1), (5, [], 2), (6, [-0.5] * 5, 2), (7, [0.25] * 16, None), (7, [0.25] * 16, None),
            (None, [0.1] * 16, 3)]
    rows += [(10 + i, [rng.uniform(-2, 2) for _ in range(16)], None) for i in range(20)]
    check(spark, rows)
    check(spark, rows[4:8])  # fewer rows than entries
    check(spark, [*rows, (90, [3e6, -7e9] * 8, 4)])  # beyond the 64-bit path
    assert gc.compress_vectors(frame(spark, rows[:4])).collect() == []
    assert gc.compress_vectors(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("collide", [False, True])
def test_cells_keep_the_nearest(monkeypatch, collide):
    if collide:
        monkeypatch.setattr(gc, "mix64", lambda x: x * np.uint64(0))
    rng = np.random.default_rng(5)
    for shape in ((16, 8), (3, 2), (1, 1)):
        entries = rng.integers(-300, 300, shape)
        parts = rng.integers(-400, 400, (500, shape[1]))
        table = gc.Cells(entries, max_cells=50)
        for some in np.array_split(parts, 5):
            index, distance = table.assign(some)
            every = ((some[:, None] - entries) ** 2).sum(axis=2)
            assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_cells_leave_out_entries():
    entries = np.array([[0, 0], [1000, 1000], [2000, 0]])
    table = gc.Cells(entries)
    table.assign(np.array([[1, 1], [2, 3]]))
    assert table.kept.sum() < table.kept.size
