"""Rewriting text with tokens and back.

``anonymize`` is the end-to-end job (C6):

1. detect spans row-locally (C1–C3); rows get an id of their own and are written
   once, so that ids hold and the regexes run once per text;
2. allocate tokens for the new values (C4, shuffles only (scope, value, ord));
3. join every span to its token (hot values split off and broadcast);
4. rows with spans get their token list by row id and are rewritten; all other
   rows pass through without a shuffle.  A row whose tokens cannot be told for sure
   is withheld, with its reason in ``rejects`` (C13).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.ruleset import RuleSet
from maskweave.operators.joins import hot_split_join
from maskweave.operators.known import MAX_CHARS, replace_in_text
from maskweave.operators.spans import detect, rule_lookup
from maskweave.operators.tables import written
from maskweave.operators.vault import allocate_tokens, empty_counters, empty_vault, first_occurrences

#: A value with this many spans is broadcast with its token, at most so many values.
HOT_VALUE_ROWS, MAX_HOT_VALUES = 1_000, 20_000
REPL = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("token", T.StringType()),
        ]
    )
)


def _spliced(col_no: int):
    def run(texts: pa.Array, repls: pa.Array) -> pa.Array:
        ends = np.cumsum(repls.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        items = repls.flatten()
        starts, stops, tokens, cols = (items.field(f).to_pylist() for f in ("start", "end", "token", "col_no"))
        out, at = [], 0
        for text, stop in zip(texts.to_pylist(), ends):
            mine = [i for i in range(at, stop) if cols[i] == col_no]
            at = stop
            if text is not None and mine:
                parts, done = [], 0
                for i in mine:
                    parts += [text[done : starts[i]], tokens[i]]
                    done = stops[i]
                text = "".join([*parts, text[done:]])
            out.append(text)
        return pa.array(out, pa.string())

    return run


def splice(text: Column, repl: Column, col_no: int) -> Column:
    """Each (start, end) of the text's own items in ``repl`` replaced by its token, in one pass from left to right.

    ``repl`` is sorted and its items do not overlap.
    """
    return F.arrow_udf(_spliced(col_no), "string")(text, repl)


def detect_rows(base: DataFrame, text_cols: list[str], rules: RuleSet) -> DataFrame:
    """Adds ``_spans{i}`` per text column; written by the caller so the rule
    regexes run exactly once per text (allocation, token join and rewrite all
    read the same detected rows)."""
    out = base
    for col_no, c in enumerate(text_cols):
        out = detect(out, c, rules, f"_spans{col_no}")
    return out


def span_occurrences(
    detected: DataFrame, key_cols: list[str], order_cols: list[str], text_cols: list[str], rules: RuleSet
) -> DataFrame:
    """One row per accepted span: keys, scope, col_no, start, end, rule, value, template, ord.

    explode_outer + null filter: a plain ``explode`` would make the optimizer
    infer ``size(spans) > 0`` and push it below the generator.
    """
    tmpl = rule_lookup(rules, "replacement")
    parts = []
    for col_no, _c in enumerate(text_cols):
        ex = detected.select(*key_cols, "scope", *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order_cols)],
                             F.explode_outer(f"_spans{col_no}").alias("s")).filter(F.col("s").isNotNull())
        parts.append(
            ex.select(
                *key_cols,
                "scope",
                F.lit(col_no).alias("col_no"),
                F.col("s.start").alias("start"),
                F.col("s.end").alias("end"),
                F.col("s.rule").alias("rule"),
                F.col("s.value").alias("value"),
                F.get(tmpl, F.col("s.rule")).alias("template"),
                F.array(
                    *[F.col(f"_o{i}").cast("long") for i in range(len(order_cols))],
                    F.lit(col_no).cast("long"),
                    (-F.col("s.start")).cast("long"),
                ).alias("ord"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Anonymized:
    df: DataFrame  # input rows with text columns rewritten + mappings and stats
    vault: DataFrame  # prior vault ∪ new rows
    new_vault: DataFrame  # rows allocated by this batch
    counters: DataFrame
    spans: DataFrame  # one row per rewritten span (keys, col_no, start, end, rule, value, token)
    rejects: DataFrame  # keys and reason of the rows whose texts are withheld


def anonymize(
    df: DataFrame,
    key_cols: list[str],
    text_cols: list[str],
    rules: RuleSet,
    vault: DataFrame | None = None,
    counters: DataFrame | None = None,
    scope: Column | str = "default",
    order_cols: list[str] | None = None,
    batch_id: int = 0,
    keep_original: bool = False,
    token_guard: bool = True,
) -> Anonymized:
    """Detect → allocate → rewrite.  ``order_cols`` (integral or timestamp)
    give the processing order for numbering; inside a text, right to left.

    It fails closed: the texts of rows with a null scope or key, of rows with
    spans that share their key, and of rows that lack a token for a span come out
    null, never as they were; ``rejects`` holds their keys and reasons."""
    spark = df.sparkSession
    prior = vault
    vault = vault if vault is not None else empty_vault(spark)
    counters = counters if counters is not None else empty_counters(spark)
    order_cols = order_cols or key_cols
    scope_col = scope if isinstance(scope, Column) else F.lit(scope)
    base = df.withColumn("scope", scope_col)
    # without scope and key a row cannot be told apart, so its texts are withheld
    no_key = F.lit(False)
    for k in key_cols:
        no_key = no_key | F.col(k).isNull()
    base = base.withColumn("_reason", F.when(F.col("scope").isNull(), "null scope").when(no_key, "null key"))
    for c in text_cols:
        base = base.withColumn(c, F.when(F.col("_reason").isNull(), F.col(c)))

    spans_names = [f"_spans{i}" for i in range(len(text_cols))]
    found = detect_rows(base, text_cols, rules)
    n_spans = sum((F.size(c) for c in spans_names), F.lit(0))
    detected = written(found.withColumn("_n", n_spans).withColumn("_row", F.monotonically_increasing_id()), "detected")
    hits = detected.filter("_n > 0")
    occ = span_occurrences(hits, ["_row"], order_cols, text_cols, rules)
    values = first_occurrences(occ.select("scope", "value", "template", "ord"))
    guarded = None
    if token_guard and prior is not None:  # a value that is a token of the prior vault stays as it is
        values = written(values, "values")
        tokens = vault.select("scope", F.col("token").alias("value")).distinct()
        guarded = values.join(tokens, ["scope", "value"], "left_semi").select("scope", "value", F.lit(None).cast("string").alias("token"))
        values = values.join(tokens, ["scope", "value"], "left_anti")

    new_rows, new_counters = allocate_tokens(values, prior, counters, [r.family for r in rules.rules], batch_id)
    new_rows = written(new_rows, "new-tokens")
    full_vault = vault.unionByName(new_rows)
    lookup = full_vault.select("scope", "value", "token")
    if guarded is not None:
        lookup = lookup.join(guarded.select("scope", "value"), ["scope", "value"], "left_anti").unionByName(guarded)

    # the most frequent values are broadcast, so that their spans do not travel to their tokens
    tokened = hot_split_join(occ.drop("template", "ord"), lookup, ["scope", "value"], hot_rows=HOT_VALUE_ROWS, max_hot=MAX_HOT_VALUES)
    pats = rule_lookup(rules, "pattern")
    item = F.struct("col_no", "start", "end", "token", "rule")
    per_row = tokened.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), item))).alias("_repl"),
        F.collect_set(F.when(F.col("token").isNotNull(), F.struct(F.col("value").alias("key"), F.col("token").alias("value")))).alias("_pairs"),
        F.count(F.lit(1)).alias("_known"),
    )

    # only rows with spans meet the per-row token lists; the rest pass through
    shared = hits.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    with_hits = hits.drop(*spans_names).join(per_row, "_row", "left")
    reason = F.when(F.coalesce("_known", F.lit(0)) != F.col("_n"), F.lit("token missing"))
    if not shared.isEmpty():
        with_hits = with_hits.join(shared, key_cols, "left")
        reason = F.when(F.col("_rows").isNotNull(), F.lit("shared key")).otherwise(reason)
    with_hits = with_hits.withColumn("_reason", reason).drop("_known", "_rows", "_n", "_row")
    for c in text_cols:
        with_hits = with_hits.withColumn(c, F.when(F.col("_reason").isNull(), F.col(c)))
    no_hits = detected.filter("_n = 0").drop(*spans_names, "_n", "_row").withColumn("_repl", F.lit(None)).withColumn("_pairs", F.lit(None))

    # a withheld row has neither items nor pairs
    given = lambda c: F.coalesce(F.when(F.col("_reason").isNull(), F.col(c)), F.array().cast(per_row.schema[c].dataType))

    def finish(d: DataFrame, hit: bool) -> DataFrame:
        d = d.withColumn("_repl", given("_repl")).withColumn("_pairs", given("_pairs"))
        if keep_original:
            for c in text_cols:
                d = d.withColumn(f"{c}_original", F.col(c))
        for col_no, c in enumerate(text_cols if hit else []):
            d = d.withColumn(c, splice(F.col(c), F.col("_repl"), col_no))
        pat_of = lambda x: F.get(pats, x["rule"])
        breakdown = F.transform(
            F.array_distinct(F.transform(F.col("_repl"), pat_of)),
            lambda p: F.struct(
                p.alias("key"), F.size(F.filter(F.col("_repl"), lambda x: pat_of(x) == p)).alias("value")
            ),
        )
        return (
            d.withColumn("mappings", F.map_from_entries("_pairs"))
            .withColumn("total_matches", F.size("_repl"))
            .withColumn("pattern_breakdown", F.map_from_entries(breakdown))
            .drop("_repl", "_pairs", "scope")
        )

    out = finish(with_hits, True).unionByName(finish(no_hits, False))
    rejects = out.filter(F.col("_reason").isNotNull()).select(*key_cols, F.col("_reason").alias("reason"))
    spans_out = tokened.filter(F.col("token").isNotNull()).join(hits.select("_row", *key_cols), "_row")
    spans_out = spans_out.select(*key_cols, "scope", "col_no", "start", "end", "rule", "value", "token")
    return Anonymized(out.drop("_reason"), full_vault, new_rows, new_counters, spans_out, rejects)


def restore(df: DataFrame, vault: DataFrame, key_cols: list[str], text_col: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """Tokens → values, longest token first, literal (no word boundary): ``IP_1`` is
    restored inside ``IP_10`` when ``IP_10`` is unknown.  Forced tokens restore like others.
    ``df`` needs a ``scope`` column; ``key_cols`` may hold anything.
    """
    pairs = vault.select("scope", F.col("token").alias("find"), F.col("value").alias("put"))
    return replace_in_text(df, text_col, pairs, F.col("scope"), max_chars)


def rehide(df: DataFrame, vault: DataFrame, text_col: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """Values → tokens, longest value first, literal and without rules.  ``df`` needs a ``scope`` column."""
    pairs = vault.select("scope", F.col("value").alias("find"), F.col("token").alias("put"))
    return replace_in_text(df, text_col, pairs, F.col("scope"), max_chars)


def rules_fingerprint(rules: RuleSet) -> str:
    """A stable fingerprint of the enabled rules (pattern, replacement, order)."""
    import hashlib

    body = "\u0000".join(f"{r.pattern}\u0001{r.replacement}" for r in rules.rules)
    return hashlib.sha256(body.encode("utf-8")).hexdigest()


def _content_hash(text_cols: list[str]) -> Column:
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(c), F.lit("\u0002")) for c in text_cols]), 256)


def content_keys(df: DataFrame, key_cols: list[str], text_cols: list[str], fingerprint: str) -> DataFrame:
    """(keys, content hash, rules fingerprint) of processed rows."""
    return df.select(*key_cols, _content_hash(text_cols).alias("content_hash"), F.lit(fingerprint).alias("rules_fp"))


def changed_rows(df: DataFrame, done: DataFrame, key_cols: list[str], text_cols: list[str], fingerprint: str) -> DataFrame:
    """Only rows whose (content hash, rules fingerprint) is not in ``done``."""
    keyed = df.withColumn("content_hash", _content_hash(text_cols)).withColumn("rules_fp", F.lit(fingerprint))
    return keyed.join(done, [*key_cols, "content_hash", "rules_fp"], "left_anti").drop("content_hash", "rules_fp")


def quarantine(df: DataFrame, text_col: str, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that may go on, rejected rows with a reason) – nothing passes raw
    when it cannot be handled."""
    reason = F.when(F.col(text_col).isNull(), F.lit("null text"))
    if max_chars is not None:
        reason = reason.when(F.length(text_col) > max_chars, F.lit("text too large"))
    tagged = df.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def reject_unparsable_json(df: DataFrame, col: str) -> DataFrame:
    """An anonymized payload must parse back to an object or an array, else the row is rejected (value nulled)."""
    kind = F.schema_of_variant(F.try_parse_json(F.col(col)))
    ok = F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))
    return df.withColumn("rejected", ~ok).withColumn(col, F.when(ok, F.col(col)))
