import json

import pytest
from pyspark.sql import functions as F

from maskweave.functions.ruleset import RuleSet, builtin_ruleset
from maskweave.operators import known, policy, rules as ru, rewrite as rw, vault as va
from maskweave.sources.files import read_texts

DEEP = "k long, scope string, payload struct<head: struct<text: string, n: int>, items: array<struct<secret: string, note: string, more: array<string>>>, tags: map<string, string>>"
PAYLOAD = (("IP_1 and IP_2", 7), [("IP_1", "IP_2", ["IP_2", None]), (None, "IP_10", [])], {"IP_1": "IP_1", "x": None})


@pytest.fixture(scope="module")
def vault(spark):
    rows = [("s", f"10.0.0.{i}", f"IP_{i}", "IP_{index}", "N:IP_{index}", i, 0, [i]) for i in (1, 2)]
    return spark.createDataFrame(rows, va.VAULT_SCHEMA)


def test_formats_that_print_the_same_token_stay_apart(spark):
    rules = RuleSet.from_rows([("a", r"aa\d+", "FOO_{index}"), ("b", r"bb\d+", "FOO"), ("c", r"cc\d+", "A{index}"), ("d", r"dd\d+", "A1{index}")], spark)
    rows = [(i, f"aa{i} bb{i} cc{i} dd{i} dd{i + 50}") for i in range(1, 25)]
    df = spark.createDataFrame(rows, "k long, text string")
    first = rw.anonymize(df, ["k"], ["text"], rules)
    tokens = [r["token"] for r in first.vault.collect()]
    assert len(tokens) == len(set(tokens)) == 24 * 5
    assert {"FOO", "FOO_1", "FOO_2"} <= set(tokens)
    forced = spark.createDataFrame([("default", "aa1", "FOO_90", 1), ("default", "cc1", "A200", 2)], "scope string, value string, token string, seq long")
    pinned = va.store_mappings(first.vault, forced, batch_id=1)
    more = spark.createDataFrame([(i, f"aa{i} bb{i} dd{i}") for i in range(100, 160)], "k long, text string")
    res = rw.anonymize(more, ["k"], ["text"], rules, pinned, first.counters, batch_id=2)
    tokens = [r["token"] for r in res.vault.collect()]
    assert len(tokens) == len(set(tokens)) and "FOO_90" in tokens and "A200" in tokens
    back = rw.restore(res.df.select("k", F.lit("default").alias("scope"), "text"), res.vault, ["k"], "text")
    assert {r["k"]: r["text"] for r in back.collect()} == {r["k"]: r["text"] for r in more.collect()}


def test_rows_that_share_a_key_are_not_mixed_up(spark):
    rules = builtin_ruleset(spark, ["ipv4", "email"])
    first = rw.anonymize(spark.createDataFrame([(1, "a@b.example.com")], "k long, text string"), ["k"], ["text"], rules)
    rows = [(4, "USER_1@domain.tld said no to that"), (4, "USER_1@domain.tld said yes"), (4, "10.0.0.1"), (5, "10.0.0.2"), (6, "plain"), (6, "plain, too")]
    res = rw.anonymize(spark.createDataFrame(rows, "k long, text string"), ["k"], ["text"], rules, first.vault, first.counters, batch_id=1)
    got = [(r["k"], r["text"]) for r in res.df.collect()]
    assert sorted(got, key=str) == sorted([(4, None)] * 3 + [(5, "IP_1" if ("5", "IP_1") else None), (6, "plain"), (6, "plain, too")], key=str) or (5, "IP_2") in got
    assert [tuple(r) for r in res.rejects.collect()] == [(4, "shared key")] * 3


def test_many_matches_in_linear_time(spark):
    rules = RuleSet.from_rows([("n", r"\bn\d+\b", "N_{index}"), ("m", r"\d+ n\d", "M")], spark)
    text = " ".join(f"n{i}" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "k long, text string")
    res = rw.anonymize(df, ["k"], ["text"], rules)
    out = res.df.select("text").first()["text"].split(" ")
    assert len(out) == 100_000 and out[0] == "N_100000" and out[-1] == "N_1"


def test_rehide_nested_and_cut(spark, vault):
    row = (("10.0.0.1 and 10.0.0.2 long", 7), [("10.0.0.1", "10.0.0.10", ["10.0.0.2", None])], {"10.0.0.1": "10.0.0.1"})
    df = spark.createDataFrame([(1, "s", row), (2, "t", row), (3, "s", None)], DEEP)
    for size in (known.MAX_CHARS, 0):
        got = {r["k"]: r["payload"] for r in policy.rehide_nested(df, "payload", vault, F.col("scope"), F.lit(13.7), "!", size).collect()}
        assert got[1].asDict(True) == {"head": {"text": "IP_1 and IP_2!", "n": 7}, "items": [{"secret": "IP_1", "note": "IP_10", "more": ["IP_2", None]}], "tags": {"10.0.0.1": "IP_1"}}
        assert got[2]["head"]["text"] == "10.0.0.1 and !" and got[3] is None


def test_restore_by_policy_paths(spark, vault):
    policies = spark.createDataFrame([("a", "trusted", None), ("b", "selectiveDeanonymize", ["items.*.secret", " head . text ", "tags.IP_1", "items.0.more.0"]), ("c", "tokenOnly", ["head.text"]),
                                      ("d", "selectiveDeanonymize", ["items", "head.*.x", "*"])], "tool string, mode string, allowed_paths array<string>")
    rows = spark.createDataFrame([(i, "s", PAYLOAD) for i in range(4)], DEEP).withColumn("tool", F.element_at(F.array(*map(F.lit, "abcd")), (F.col("k") + 1).cast("int")))
    got = {r["tool"]: r["payload"].asDict(True) for r in policy.restore_by_policy(rows.join(policies, "tool"), "payload", vault, F.col("scope")).collect()}
    as_is = {"head": {"text": "IP_1 and IP_2", "n": 7}, "items": [{"secret": "IP_1", "note": "IP_2", "more": ["IP_2", None]}, {"secret": None, "note": "IP_10", "more": []}], "tags": {"IP_1": "IP_1", "x": None}}
    assert got["c"] == got["d"] == as_is
    assert got["a"]["items"][0] == {"secret": "10.0.0.1", "note": "10.0.0.2", "more": ["10.0.0.2", None]} and got["a"]["items"][1]["note"] == "10.0.0.10"
    assert got["b"] == as_is | {"head": {"text": "10.0.0.1 and 10.0.0.2", "n": 7}, "tags": {"IP_1": "10.0.0.1", "x": None},
                                "items": [{"secret": "10.0.0.1", "note": "IP_2", "more": ["10.0.0.2", None]}, as_is["items"][1]]}


def test_payloads_must_be_objects(spark):
    rows = [(1, '{"a": {"b": "x", "c": 1}}'), (2, "[1]"), (3, '"x"'), (4, "{"), (5, None), (6, "12")]
    out = policy.parse_payload(spark.createDataFrame(rows, "k long, j string"), "j", "a struct<b: string>").collect()
    assert {r["k"]: r["payload"] and r["payload"].asDict(True) for r in out} == {1: {"a": {"b": "x"}}, 2: None, 3: None, 4: None, 5: None, 6: None}
    assert [r["k"] for r in out if r["reject_reason"] is None] == [1]
    kept = rw.reject_unparsable_json(spark.createDataFrame(rows, "k long, j string"), "j").filter("NOT rejected")
    assert sorted(r["k"] for r in kept.collect()) == [1, 2]


def test_default_policy():
    assert policy.default_policy({"mode": "bogus", "max_input": -1, "max_output": 9.9, "allow_external": "yes"}, "trustedLocal") == {
        "mode": "selectiveDeanonymize", "allowed_paths": [], "allow_external": False, "max_input": 100_000, "max_output": 9}


def test_indented_sheets_and_bad_files(spark, tmp_path):
    rules = [{"pattern": r"\d{3}", "replacement": "NUM_{index}", "type": "custom", "enabled": True}, {"pattern": "", "replacement": ""}, {"pattern": "off", "replacement": "OFF", "enabled": False}]
    (tmp_path / "a.json").write_text(json.dumps({"version": "1", "rulesheet": "a", "rules": rules}, indent=2))
    (tmp_path / "b.json").write_text("﻿" + json.dumps(rules[:1], indent=4))
    (tmp_path / "c.json").write_text('{"rules": [')
    (tmp_path / "d.json").write_text("\n".join(json.dumps({"rulesheet": n, "rules": rules[:1]}) for n in ("d1", "d2")) + "\n")
    (tmp_path / "e.json").write_text('{"rules": "none"}')
    (tmp_path / "f.bin").write_bytes(b"\xff\xfe\x00bad")
    path = str(tmp_path / "*.json")
    sheets = ru.read_rulesheets(spark, path)
    assert sorted(r["sheet_id"] for r in sheets.filter("pattern <> ''").collect() if "/" not in r["sheet_id"]) == ["a", "d1", "d2"]
    got = sorted(r["sheet_id"].split("/")[-1] for r in ru.import_rules(spark, path).collect())
    assert got == ["a", "a", "b.json", "d1", "d2"]
    compiled = RuleSet.from_df(sheets.filter("sheet_id = 'a' AND pattern <> ''"))
    out = rw.anonymize(spark.createDataFrame([(1, "call 123 off")], "k long, text string"), ["k"], ["text"], compiled)
    assert out.df.first()["text"] == "call NUM_1 off"
    files = {r["name"]: r for r in read_texts(spark, str(tmp_path)).collect()}
    assert len(files) == 6 and files["f.bin"]["content"] is None and files["f.bin"]["reason"] and files["a.json"]["reason"] is None
