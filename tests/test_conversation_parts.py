from maskweave.functions import ruleset
from maskweave.operators.conversations import anonymize_parts


def test_parts_of_one_turn_are_anonymized_apart(spark):
    rules = ruleset.builtin_ruleset(spark, ["ipv4"])
    rows = [
        (1, 0, 0, "text", "host 10.0.0.1 and 10.0.0.2"), (1, 0, 1, "tool_call", '{"host": "10.0.0.2"}'), (1, 0, 2, "tool_result", "to 10.0.0.3"),
        (1, 0, 3, "binary", "raw 10.0.0.4"), (1, 1, 0, "text", "again 10.0.0.1"),
    ]
    parts = spark.createDataFrame(rows, "conv_id long, turn long, part_no int, part_kind string, payload string")
    got = {(r["turn"], r["part_no"]): r for r in anonymize_parts(parts, rules).collect()}
    texts = {k: r["payload"] for k, r in got.items()}
    assert len(got) == 5 and not any(r["rejected"] for r in got.values()) and texts[0, 3] == "raw 10.0.0.4"
    assert all(t is not None for t in texts.values()) and not any("10.0.0." in t for k, t in texts.items() if k != (0, 3))
    token = texts[1, 0].removeprefix("again ")
    words = texts[0, 0].split()
    assert token in words and texts[0, 1] == '{"host": "%s"}' % next(w for w in words if w not in ("host", "and", token))
    assert texts[0, 2].removeprefix("to ") not in words
