import pytest
from pyspark.sql import functions as F

from maskweave.functions import ruleset
from maskweave.functions.patterns import is_wildcard, wildcard_to_js
from maskweave.operators import rewrite as rw


def test_no_raw_text_without_scope_key_or_with_a_shared_key(spark):
    rules = ruleset.builtin_ruleset(spark, ["ipv4"])
    rows = [(1, "a", "host 10.0.0.1"), (2, None, "host 10.0.0.2"), (None, "a", "host 10.0.0.3"), (4, "a", "see 10.0.0.4"), (4, "a", "or 10.0.0.5 now"), (5, "a", "plain")]
    df = spark.createDataFrame(rows, "k long, s string, text string")
    got = [r["text"] for r in rw.anonymize(df, ["k"], ["text"], rules, scope=F.col("s")).df.collect()]
    assert len(got) == 6 and not any("10.0.0" in (t or "") for t in got)
    assert "plain" in got and sum(t is None for t in got) == 4


def test_too_many_rules_fail_before_any_is_dropped(spark):
    rows = [(str(i), "(" if i == 0 else f"x{i}", "T_{index}") for i in range(ruleset.MAX_RULES + 1)]
    with pytest.raises(ValueError):
        ruleset.RuleSet.from_rows(rows)
    df = spark.range(ruleset.MAX_RULES + 1).selectExpr("cast(id as string) AS id", "concat('x', id) AS pattern", "'T' AS replacement", "false AS enabled")
    with pytest.raises(ValueError):
        ruleset.RuleSet.from_df(df)


def test_wildcards():
    assert is_wildcard("srv-*.corp?") and not is_wildcard(r"srv\*") and not is_wildcard(r"a*|b") and not is_wildcard(r"\d*")
    assert wildcard_to_js(r"a.*\*?b\c") == r"a\.[^\s]*\*[^\s]b\\c"
