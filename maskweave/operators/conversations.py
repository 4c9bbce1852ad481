"""Conversations (rows ``conv_id, turn, role, text``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.functions.ruleset import RuleSet
from maskweave.operators.rewrite import Anonymized, anonymize


def anonymize_conversations(conv: DataFrame, rules: RuleSet, vault=None, counters=None,
                            scope="default") -> Anonymized:
    """Every turn anonymized in (conv_id, turn) order against one vault per scope;
    roles other than user/assistant (system) are anonymized too."""
    return anonymize(conv, ["conv_id", "turn"], ["text"], rules, vault, counters, scope=scope,
                     order_cols=["conv_id", "turn"])


def attach_files(messages: DataFrame, files: DataFrame) -> DataFrame:
    """Per message, its (already anonymized) files appended as
    ``[Attached file: name]`` + fenced block, parts joined by blank lines.
    ``files``: conv_id, turn, file_no, name, text."""
    blocks = files.select(
        "conv_id", "turn", "file_no",
        F.concat(F.lit("[Attached file: "), F.col("name"), F.lit("]\n```\n"), F.col("text"), F.lit("\n```")).alias("block"))
    per_msg = blocks.groupBy("conv_id", "turn").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_no", "block"))), lambda x: x["block"]), "\n\n")
        .alias("attachments"))
    j = messages.join(per_msg, ["conv_id", "turn"], "left")
    return j.withColumn("text", F.when(F.col("attachments").isNull(), F.col("text"))
                        .otherwise(F.concat(F.col("text"), F.lit("\n\n"), F.col("attachments")))).drop("attachments")


def assemble_transcript(turns: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """One transcript per conversation: turns in order as ``role: text``,
    empty assistant turns dropped; when the conversation uses tokens, a first
    line lists them (``tokens``: conv_id, token_list)."""
    kept = turns.filter(~((F.col("role") == "assistant") & (F.coalesce(F.length("text"), F.lit(0)) == 0)))
    t = kept.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))),
                                 lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n").alias("body"))
    if tokens is not None:
        t = t.join(tokens, ["conv_id"], "left").withColumn(
            "transcript", F.when(F.col("token_list").isNull(), F.col("body")).otherwise(
                F.concat(F.lit("[active tokens: "), F.col("token_list"), F.lit("]\n"), F.col("body")))).drop("body", "token_list")
    else:
        t = t.withColumnRenamed("body", "transcript")
    return t


def anonymize_parts(parts: DataFrame, rules: RuleSet, vault=None, counters=None, scope="default") -> DataFrame:
    """Message parts by kind – ``text`` and ``tool_result`` anonymized as text,
    ``tool_call`` payloads anonymized as serialized JSON that must parse back
    (else rejected), ``binary`` passed through.  One vault for all parts.
    ``parts``: conv_id, turn, part_no, part_kind, payload; a turn has any number of parts,
    and ``part_no`` tells them apart and orders them."""
    from maskweave.operators.rewrite import reject_unparsable_json

    work = parts.filter(F.col("part_kind") != "binary")
    key = ["conv_id", "turn", "part_no"]
    res = anonymize(work, key, ["payload"], rules, vault, counters, scope=scope, order_cols=key)
    out = res.df.select(*key, "part_kind", "payload")
    calls = reject_unparsable_json(out.filter(F.col("part_kind") == "tool_call"), "payload")
    texts = out.filter(F.col("part_kind") != "tool_call").withColumn("rejected", F.lit(False))
    binary = parts.filter(F.col("part_kind") == "binary").select(*key, "part_kind", "payload") \
        .withColumn("rejected", F.lit(False))
    return calls.unionByName(texts).unionByName(binary)
