import hashlib
import random
import re

from maskweave.llm.langid_cnn import fit as fit_lang, identify, keep_known
from maskweave.llm.pii_bootstrap import find_personal_data, mask
from maskweave.llm.quality_gam import fit as fit_quality, score_quality
from .conftest import EDGES

WORDS = {"en": "the of and house tree water light".split(), "de": "der und haus baum wasser licht nicht".split(), "xx": "zvq qrr vvx xaz".split()}


def spoken(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(8, 90))), "s", lang) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]


def test_language_held_out_accuracy_and_edges(make, edges, empty):
    rows = spoken(400)
    docs = make(rows)
    model = fit_lang(docs)
    got = {r["doc_id"]: r for r in identify(docs, model).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert 40 < len(held) < 120 and sum(got[r[0]]["lang_pred"] == r[3] for r in held) >= 0.95 * len(held)
    odd = {r["doc_id"]: r for r in identify(edges, model).collect()}
    assert len(identify(edges, model).collect()) == len(EDGES)
    assert [odd[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and odd[4]["lang_pred"] in model.langs and odd[8]["lang_pred"] != "und"
    assert identify(make([(1, "123 456 !!")]), model).first()["lang_pred"] == "und"
    kept = keep_known(edges, model, 0.0)
    assert kept.columns == edges.columns and kept.count() == len(EDGES) - 3
    nothing = fit_lang(empty)
    assert identify(empty, nothing).count() == 0 and identify(edges, nothing).first()["lang_pred"] == "und"


def test_quality_held_out_accuracy_and_edges(make, spark, edges, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.8
        words = rng.choices([f"word{j}" for j in range(400)], k=rng.randint(20, 120))
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words) if rng.random() < 0.5 else " ".join(words[:2] * 30)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    docs, marked = make(rows), spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, marked)
    got = {r["doc_id"]: r for r in score_quality(docs, model).collect()}
    held = [x for x in labels if got[x[0]]["held_out"]]
    assert sum(got[i]["predicted"] == y for i, y, _ in held) >= 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    again = {r["doc_id"]: r["score"] for r in score_quality(docs.repartition(5), fit_quality(docs.repartition(2), marked)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    assert score_quality(edges, model).count() == len(EDGES) and score_quality(empty, model).count() == 0
    assert score_quality(edges, fit_quality(empty, marked)).first()["score"] == 0.5


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "card":
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and luhn % 10 == 0
    return kind == "email" or (all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else 10 <= len(d) <= 15)


def base_spans(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if holds(k, m.group()))


def test_base_spans_equal_the_contract(make, edges, empty):
    rng = random.Random(9)
    bits = ["a@b.co", "x@y", "..", ".", "@", "1.2.3.4", "001.2.3.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112",
            "4111-1111-1111-1111", "+1 (555) 010-2345", "+49", "30", " ", "é", "😀", "_", "-", "a.b+c@d-e.f.g", "@q.r", "+", "(", "\n", "0000000000000000"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(1, 25)))) for i in range(400)]
    rows += [(900, "a" * 3000), (901, "a." * 1000 + "@b." + "c." * 3000), (902, "1" * 2000), (903, "+" + "1 " * 2000), (904, "1.2.3.4 " * 500)]
    got = {r["doc_id"]: r for r in find_personal_data(make(rows)).collect()}
    for i, text in rows:
        want = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest(), text[:80]
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w[3] == k for w in want) for k in BASE]
    assert find_personal_data(edges).count() == len(EDGES) and find_personal_data(empty).count() == 0


def test_patterns_discover_unseen_identifiers(make):
    rows = [(i, f"please call us at +1 (555) 01{i % 10}-23{i:02d} now") for i in range(20)]
    rows += [(100, "please call us at 555-0199-22 now"), (101, "it cost 555-0199-22 then")]
    got = {r["doc_id"]: r for r in find_personal_data(make(rows)).collect()}
    assert got[100]["n_phone"] == 0 and got[100]["spans"] == "phone:18:29" and got[101]["spans"] == ""
    masked = {r["doc_id"]: r for r in mask(make(rows)).collect()}
    assert masked[100]["text"] == "please call us at [PHONE] now" and masked[100]["n_chars"] == len(masked[100]["text"])
    assert masked[3]["text"] == "please call us at [PHONE] now" and masked[101]["text"] == rows[-1][1]


def test_contexts_reach_over_digit_words_and_text_starts(make):
    rows = [(i, f"Order {i} phone: +1 (555) 01{i % 10}-23{i:02d} now") for i in range(20)]
    rows += [(50 + i, f"Phone: +1 (555) 02{i % 10}-24{i:02d}, or +1 (555) 03{i % 10}-25{i:02d}") for i in range(20)]
    long = "x" * 80
    rows += [(80 + i, f"{long} {long}: +1 (555) 04{i % 10}-26{i:02d}") for i in range(5)]
    rows += [
        (100, "Order 42 phone: 555-0199-22"), (101, "Phone: 555-0199"), (102, "Order 7 phone: (555) 019 2233, then 4"), (103, f"1 {long} {long}: 555-0188"),
        (104, "2 lists. Order 9 phone: 555\t0199"), (105, "555-0177-33 alone"), (106, ""),
    ]
    got = {r["doc_id"]: r for r in find_personal_data(make(rows)).collect()}
    assert [got[i]["spans"] for i in (100, 101, 102)] == ["phone:16:27", "phone:7:15", "phone:16:29"]
    assert got[103]["spans"] == "phone:165:173" and got[104]["spans"] == "" and got[105]["spans"] == ""
    assert got[50]["n_phone"] == 2 and got[50]["spans"].count("phone") == 2
    masked = {r["doc_id"]: r["text"] for r in mask(make(rows)).collect()}
    assert masked[100] == "Order 42 phone: [PHONE]" and masked[102] == "Order 7 phone: ([PHONE], then 4"


def test_mask_keeps_rows_and_columns(edges, empty, make):
    out = mask(edges)
    key = lambda r: (str(r["doc_id"]), r["text"] or "")
    assert out.columns == edges.columns and sorted(map(key, out.collect())) == sorted(map(key, edges.collect()))
    assert mask(empty).count() == 0
    both = mask(make([(1, "x +1 2345678901234 y a@b.c z")])).first()["text"]
    assert both.count("[") == 2 and "a@b" not in both and "2345" not in both
