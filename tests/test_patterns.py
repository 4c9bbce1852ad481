"""Pattern translation: wildcard vs regex, and JavaScript semantics kept in Java."""

import re

import pytest

from maskweave.functions.patterns import PatternError, rule_regex, rule_to_js, wildcard_to_js


def test_wildcard_ip_is_literal_plus_nonspace():
    assert rule_to_js("10.123.*.*") == r"10\.123\.[^\s]*\.[^\s]*"


def test_regex_kept_when_regex_syntax_present():
    assert rule_to_js(r"\bORD-[0-9]+\b") == r"\bORD-[0-9]+\b"


def test_plain_pattern_is_a_live_regex():
    # no wildcard: dots stay live
    assert rule_to_js("10.0.0.1") == "10.0.0.1"


def test_escaped_wildcard_is_literal():
    assert wildcard_to_js(r"a\*b*") == r"a\*b[^\s]*"


@pytest.mark.parametrize("bad", ["a++", "(?i)abc", "(ab", "[abc"])
def test_invalid_patterns_rejected(bad):
    with pytest.raises(PatternError):
        rule_regex(bad)


def test_word_boundary_is_ascii():
    rx = rule_regex(r"\b10\.0\b")
    # python's re follows the same lookaround semantics as the java translation
    assert re.search(rx.replace("\\u00a0", " "), "é10.0 x") is not None


def test_required_literals():
    from maskweave.functions.patterns import js_to_java, required_literals
    from maskweave.functions.ruleset import BUILTIN_RULES

    got = {r[0]: required_literals(js_to_java(r[2])) for r in BUILTIN_RULES}
    assert got["email"] == ["@"] and got["ipv6"] == [":"] and got["jwt"] == ["eyJ"] and got["uuid"] == ["-"]
    assert got["api-keys"] == ["AIza", "AKIA", "ghp_", "sk-"]
    assert required_literals("a?b*(?:cd|e)") == ["cd", "e"]
    for regex in ("(?i)abc", "(?i:abc)", "a|b?", "[ab]", r"\Qab\E", "x?"):
        assert required_literals(regex) is None
