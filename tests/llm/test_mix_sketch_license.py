import hashlib
import random
import re

import numpy as np

from maskweave.llm.license_templates import scan_licenses
from maskweave.llm.mixing import mix, plan_mix, split_tree
from maskweave.llm.sketch import fingerprint_documents
from .conftest import CLASH, EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_hand(sizes):
    """Weights 5, 2, 1 by code point, null last; 150 % of all words; never above twice a source's words."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, rest, out = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        w = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / w >= 2 * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / w for s in left}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left.discard(s)
        rest -= sum(2.0 * sizes[s] for s in over)
    return out


def test_mix_targets_and_takes(make):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40, 400]))), rng.choice(["a", "b", "Z", "é", None, "c", "c", "c"])) for i in range(400)]
    docs = make(rows)
    got = {r["doc_id"]: r for r in plan_mix(docs, shard_words=2000).collect()}
    sizes, taken = {}, {}
    for i, text, source in rows:
        assert got[i]["size"] == len(WORD.findall(text)) and 0 <= got[i]["taken"] <= 2 * got[i]["size"]
        sizes[source] = sizes.get(source, 0) + got[i]["size"]
        taken[source] = taken.get(source, 0) + got[i]["taken"]
    want = targets_by_hand(sizes)
    for i, _, source in rows:
        assert got[i]["source_size"] == sizes[source] and abs(got[i]["target"] - want[source]) < 1e-6 * max(1, want[source])
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = {r["doc_id"]: r for r in plan_mix(docs.repartition(7), shard_words=2000).collect()}
    assert again == got
    out = mix(docs, shard_words=2000)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
        assert rows[r["doc_id"]][1].startswith(r["text"])
    assert words == {s: n for s, n in taken.items() if n}


def test_split_tree_keeps_quotas():
    counts = np.array([5, 0, 1000, 37])
    got = split_tree(counts, 7, [1, 2])
    for i, n in enumerate(counts):
        assert sum(c for a, _, c in got if a == i) == n
    per_shard = [sum(c for _, s, c in got if s == k) for k in range(7)]
    assert max(per_shard) - min(per_shard) <= 1 and got == split_tree(counts, 7, [1, 2])


def test_mix_edges(edges, empty):
    got = plan_mix(edges).collect()
    assert len(got) == len(EDGES) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert set(CLASH) <= set(mix(edges).columns)
    assert plan_mix(empty).count() == 0 and mix(empty).count() == 0


def test_sketch_contract(make):
    base = " ".join(f"t{i}" for i in range(300))
    rows = [(1, base), (2, base), (3, base[: len(base) // 2] + " other tail"), (4, "short"), (5, None), (9, "x y z " * 100)]
    got = {r["doc_id"]: r for r in fingerprint_documents(make(rows)).collect()}
    order = sorted((r for r in rows), reverse=True, key=lambda r: r[0])
    for a, b in zip(order, order[1:] + order[:1]):
        x, y = a[1] or "", b[1] or ""
        h = len(x) // 2
        assert got[a[0]]["edited_sha256"] == hashlib.sha256((x[: len(x) - h] + y[:h]).encode()).hexdigest()
        assert got[a[0]]["n_chars"] == len(x)
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != "" and got[2]["near_next"] == 1.0
    assert got[3]["near_next"] > 0.2 > got[4]["near_next"] and 0.1 < got[9]["near_edited"] <= 1


def test_sketch_edges(edges, empty, make):
    got = fingerprint_documents(edges).collect()
    assert len(got) == len(EDGES) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprint_documents(empty).count() == 0
    assert fingerprint_documents(make([(3, "only one")])).first()["near_next"] == 1.0


def test_license_phrases_and_templates(make, edges, empty):
    rows = [
        (1, "Released under the MIT License. under the mit license"), (2, "Licensed under CC BY-NC 4.0."), (3, "under the mit\n licence"),
        (4, "This work is licensed under the GNU General Public License, version 3."), (5, "Licensed under the Apache License, Version 2.0."),
        (6, "licensed under the terms of the GNU General Public License as published by the Free Software Foundation version 2"),
        (7, "licensed under the GNU General Public License as published by one two three four five six seven version 2"),
    ]
    got = {r["doc_id"]: r for r in scan_licenses(make(rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["score"]) == (2, 1, 5, "mit", 1.0)
    assert got[2]["base_labels"] == got[2]["labels"] == "cc-by-nc" and got[2]["n_words"] == 7
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["labels"], got[3]["score"]) == (0, None, "", 0.0)
    assert (got[4]["base_labels"], got[4]["labels"]) == ("", "gpl-3") and got[5]["labels"] == "apache-2"
    assert got[6]["labels"] == "gpl-2" and got[7]["labels"] == ""  # seven words do not fit a place for six
    assert scan_licenses(edges).count() == len(EDGES) and scan_licenses(empty).count() == 0
