import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from maskweave.llm import periodic_runs as pr
from .conftest import EDGES, LONG


def brute_runs(words):
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                stretch = words[i : i + length]
                if not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                    out.add((i, length, q))
            i = j
    return sorted(out)


def brute_row(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def words_of(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(0, 120))]
    if kind == 1:  # Thue-Morse: no run, and hard for running hashes
        return [str(bin(i).count("1") % 2) for i in range(rng.randrange(1, 300))]
    out = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.choice("abcde") for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 21]))]
        out += (unit * 9)[: rng.randrange(1, 9 * len(unit) + 1)]
        out += [f"u{rng.randrange(50)}" for _ in range(rng.randrange(0, 9))]
    return out


def test_transform_is_exact_correlation():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 64):
        block, window = (rng.integers(0, int(pr.PRIME), (3, k * size)).astype(np.uint64) for k in (1, 2))
        want = [[sum(int(x) * int(y) for x, y in zip(b, w[d:])) % int(pr.PRIME) for d in range(size)] for b, w in zip(block, window)]
        assert pr.correlations(block, window).tolist() == want


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        words = words_of(rng)
        codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
        got = pr.runs_of(np.array([codes[w] for w in words], np.int64), len(words))
        assert [tuple(r) for r in got.tolist()] == brute_runs(words), words


def test_long_runs_and_small_steps(monkeypatch):
    monkeypatch.setattr(pr, "POINTS", 64)
    unit = list(range(1000))
    words = np.array([5000, *(unit * 5), 5001, *([7] * 9000), 5002, *([7] * 9000)])
    assert pr.runs_of(words, len(words)).tolist() == [[1, 5000, 1000], [5002, 9000, 1], [14003, 9000, 1]]


def test_hash_collisions_do_not_count(monkeypatch):
    monkeypatch.setattr(pr, "mix64", lambda x: x * np.uint64(0))  # every hash is equal
    rng = random.Random(6)
    for _ in range(60):
        words = words_of(rng)
        codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
        got = pr.runs_of(np.array([codes[w] for w in words], np.int64), len(words))
        assert [tuple(r) for r in got.tolist()] == brute_runs(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(i, rng.choice(["  ", " ", "\n", "\t "]).join(words_of(rng))) for i in range(200)]
    return out + [(300, "x " * 50_000), (301, "a b " * 3), (301, "a b " * 3)]


def test_query_equals_brute_force(make, rows):
    got = sorted((tuple(r) for r in pr.run_digests(make(rows)).collect()))
    small = [r for r in rows if r[0] != 300]
    assert [g for g in got if g[0] != 300] == sorted((i, *brute_row(i, t)) for i, t in small)
    assert [g[1:5] for g in got if g[0] == 300] == [(1, 0, 50_000, 1)]


def test_edges(edges, empty):
    got = {r[0]: tuple(r)[1:] for r in pr.run_digests(edges).collect()}
    assert len(got) == len({r[0] for r in EDGES})
    for doc_id, text in EDGES:
        if text != LONG:
            assert got[doc_id] == brute_row(doc_id, text), doc_id
    assert pr.run_digests(edges).count() == len(EDGES)
    assert pr.run_digests(empty).collect() == []
