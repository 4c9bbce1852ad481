import random
import re

import numpy as np

from maskweave.llm.circulant_minhash import keep_one, near_duplicates, second_permutation, signatures
from maskweave.llm.components import components
from maskweave.llm.va_file import top_k
from .conftest import EDGES

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(make):
    rng = random.Random(2)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 8, 20])):
            new = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                new[rng.randrange(len(new))] = word()
            rows.append((len(rows) * 7 % 1009, "  ".join(new).upper() if rng.random() < 0.3 else " ".join(new)))
    passage = " ".join(word() for _ in range(60))
    rows += [(2000 + i, passage + " " + " ".join(word() for _ in range(40))) for i in range(30)]
    chain = [f"c{i}" for i in range(60)]
    for i in range(30):  # each like the next one, the first not like the last one
        rows.append((5000 - i, " ".join(chain)))
        chain[i * 2] = word()
    docs = make(rows)
    want = brute(rows)
    got = near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_near_duplicates_edges(edges, empty):
    got = near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["component_id"] == i and by[i]["n_shingles"] == 0 for i in (1, 2, 3))
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[None]["component_id"] is None
    ids = [r["doc_id"] for r in keep_one(edges).collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, 9, None]))
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0


def test_null_and_repeated_ids_with_different_texts_stay_apart(make):
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    near = lambda s: text(s) + " end"
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (1, near("a")), (2, near("b")), (3, text("d")), (3, text("e")), (3, text("e").upper())]
    rows += [(9, text("f")), (9, text("g")), (4, near("g")), (None, None), (None, ""), (5, None), (5, "")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(make(rows)).collect()]
    null = [g for g in got if g[0] is None and g[1]]
    assert sorted(map(str, null)) == sorted(map(str, [(None, 36, 1, False), (None, 36, 2, False), (None, 36, None, True), (None, 36, None, False)]))
    assert sorted(g[3] for g in got if g[0] == 3) == [False, True, True] and sorted(g[2:] for g in got if g[0] == 9) == [(4, False), (9, True)]
    kept = sorted(((r["doc_id"], (r["text"] or "").lower()[:3]) for r in keep_one(make(rows)).collect()), key=str)
    assert kept == sorted([(1, "a0 "), (2, "b0 "), (None, "c0 "), (3, "d0 "), (3, "e0 "), (4, "g0 "), (9, "f0 "), (None, ""), (None, ""), (5, "")], key=str)


def test_signature_is_shifted_minimum():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2**63, 9000).astype(np.uint64)
    before, length = np.array([0, 0, 10, 9000]), 24
    p = second_permutation(length, 1 << 10)
    got = signatures(s, before, p, length)
    assert (got[0] == 1 << 10).all()
    for k in range(length):
        assert got[1][k] == min(p[(int(x) + k) % 1024] for x in s[:10] % np.uint64(1024))


def test_components_of_a_path(spark):
    n = 200
    links = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)], "a long, b long")
    got = components(links).collect()
    assert len(got) == n and {r["root"] for r in got} == {0}
    assert components(links.filter("a < 0")).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vecs = [(i, [float(x) for x in rng.normal(0, 0.3, 16).astype(np.float32)]) for i in range(900)]
    vecs += [(1000 + i, vecs[0][1]) for i in range(40)]  # ties
    bad = [(20_000, None), (20_020, [1.0, None]), (20_040, [float("nan"), 1.0]), (20_060, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs + bad], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in top_k(df, df.filter("vec_id % 20 = 0"), data_rows=200, query_rows=20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    whole = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vecs}
    assert set(got) == {i for i in whole if i % 20 == 0}
    for q, found in got.items():
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:20]
        assert [found[k + 1] for k in range(20)] == [(i, -s) for s, i in best]


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, []), (20, [1e300]), (20, [2.0])], schema)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(few, few.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 20), (0, 2, 1), (0, 3, 20), (0, 4, 2)] and got[0][3] == 2**63 - 1
    assert {g[2] for g in got if g[0] == 20} == {0, 1, 2}
    assert top_k(few.filter("vec_id > 99"), few).count() == 0 and top_k(few, few.filter("vec_id > 99")).count() == 0
    assert top_k(few.filter("vec_id = 0"), few.filter("vec_id = 0")).count() == 0
