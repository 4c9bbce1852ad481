import hashlib
import random

import numpy as np
import pytest

from maskweave.llm import suffix_dedup as sd
from .conftest import EDGES


def brute(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words(rng, n, kinds=4000):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def corpus(rng):
    rows = []
    passage, short = words(rng, 150), words(rng, 55)
    assert len(passage) > 400 > len(short)
    for i in range(25):  # passages amid different texts, cut at every place
        at = rng.randrange(0, 60)
        rows.append((i, words(rng, rng.randrange(0, 90)) + passage[at : at + rng.choice([399, 400, 401, 520])] + words(rng, rng.randrange(0, 90))))
        rows.append((100 + i, words(rng, 40) + " " + short + " " + words(rng, 60)))
    base = words(rng, 400)
    for i in range(12):  # near copies
        t = base.split()
        t[rng.randrange(len(t))] = "édité"
        rows.append((200 + i, " ".join(t)))
    rows += [(300 + i, base[:1500]) for i in range(5)]  # exact copies, also part of the near ones
    rows += [(400, "a" * 3000), (401, "ab" * 700 + "c"), (402, words(rng, 90) + "a" * 400), (403, "x" + "a" * 401), (404, "z" * 400), (405, "é" * 200), (406, "é" * 199 + "è")]
    rows += [(407, (words(rng, 70) + "\n") * 4), (408, "z" * 399)]
    return rows


@pytest.mark.parametrize("group", [sd.GROUP, 3])
def test_equals_brute_force(make, group, monkeypatch):
    rows = corpus(random.Random(11))
    real = sd.repeated_spans
    monkeypatch.setattr(sd, "repeated_spans", lambda docs: real(docs, group=group, at_once=5))
    got = sorted((tuple(r) for r in sd.drop_repeats(make(rows)).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 10_000


def test_edges(edges, empty):
    got = sorted((tuple(r) for r in sd.drop_repeats(edges).collect()), key=str)
    assert got == brute(EDGES)
    assert sd.drop_repeats(empty).collect() == []


def test_first_minima():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40):
        values = rng.integers(0, 4, n).astype(np.uint64)
        for width in (1, 2, 5, 7):
            want = [i + int(np.argmin(values[i : i + width])) for i in range(n - width + 1)]
            assert sd.first_minima(values, width).tolist() == want


def test_quicksort_orders_groups():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 2, (200, 16)).astype(np.uint8)
    group = rng.integers(0, 3, 200)
    order = sd.quicksort(rows.view(">u8").astype(np.uint64), group)
    got = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert got == sorted(got)
    common = sd.common_prefixes(rows, group, order)
    for k in range(1, 200):
        a, b = rows[order[k - 1]], rows[order[k]]
        same = next((i for i in range(16) if a[i] != b[i]), 16)
        assert common[k] == (same if group[order[k]] == group[order[k - 1]] else -1)
