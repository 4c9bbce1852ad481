"""Rule normalization, policies, sanitizer (the reference's own test expectations)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.text import truncate_text
from maskweave.operators import policy as po
from maskweave.operators import rules as ru

RULES_T = "sheet_id string, ordinal int, id string, type string, pattern string, replacement string, enabled boolean, description string"


def test_merge_keeps_stored_metadata(spark):
    stored = spark.createDataFrame([("s", 0, "r1", "email", "old", "OLD", False, "kept")], RULES_T)
    incoming = spark.createDataFrame([("s", 0, "r1", None, "new", "NEW", None, None)], RULES_T)
    r = ru.merge_rules(stored, incoming).first()
    assert (r.pattern, r.replacement, r.type, r.enabled, r.description) == ("new", "NEW", "email", False, "kept")


def test_imported_rule_defaults(spark):
    raw = spark.createDataFrame([("s", 0, None, None, "x", "X", None, None)], RULES_T)
    r = ru.normalize_rules(raw).first()
    assert (r.type, r.enabled, r.description) == ("custom", True, "")
    assert r.id.startswith("rule_")


def test_validate_flags_bad_replacement(spark):
    raw = spark.createDataFrame([("s", 0, "a", "custom", "x", "9bad", True, ""),
                                 ("s", 1, "b", "custom", "10.*.*.*", "IP_{index}", True, "")], RULES_T)
    issues = [(r.rule_no, r.issue) for r in ru.validate_rules(raw).collect()]
    assert issues == [(1, "replacement is invalid")]


def test_token_only_policy_allows_and_selective_gate(spark):
    pol = spark.createDataFrame([("ext", "selectiveDeanonymize", ["credentials.password"], None, None, None)],
                                "tool string, mode string, allowed_paths array<string>, allow_external boolean, "
                                "max_input double, max_output double")
    norm = po.normalize_policies(pol)
    ev = spark.createDataFrame([(1, "ext"), (2, "other")], ["id", "tool"])
    g = {r.id: r.allowed for r in po.gate_rows(po.with_policy(ev, "tool", norm), "tool").collect()}
    assert g == {1: False, 2: True}


def test_truncate_marks_cut_text(spark):
    df = spark.createDataFrame([("x" * 30,)], ["t"])
    out = df.select(truncate_text(F.col("t"), 18, "\n[cut]").alias("t")).first().t
    assert out == "x" * 18 + "\n[cut]"
