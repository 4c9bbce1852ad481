"""Text patches, output caps, trust policies, gates and nested payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions.nested import map_leaves, path_allowed, path_segments, string_leaves
from maskweave.functions.text import truncate_text
from maskweave.operators.known import MAX_CHARS, replace_known

# The built-in default policy, the valid modes and the presets' changes to the default.
DEFAULT_POLICY = {"mode": "tokenOnly", "allowed_paths": [], "allow_external": False, "max_input": 100_000, "max_output": 150_000}
MODES = ["tokenOnly", "selectiveDeanonymize", "trusted"]
PRESETS = {
    "strict": {},
    "balanced": {"mode": "tokenOnly", "allow_external": False, "max_output": 120_000},
    "trustedLocal": {"mode": "selectiveDeanonymize", "allow_external": False},
}


def _pos_int(c: Column, fallback: Column) -> Column:
    """floor(x) when finite and > 0 after flooring, else the fallback."""
    x = c.cast("double")
    fl = F.floor(x)
    return F.when(c.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (fl > 0), fl.cast("long")).otherwise(fallback)


def _paths(c: Column) -> Column:
    trimmed = F.transform(c, lambda p: F.regexp_replace(p, r"^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$", ""))
    return F.filter(trimmed, lambda p: p.isNotNull() & (p != ""))


def default_policy(configured: dict | None = None, preset: str = "strict") -> dict:
    """The default policy: the built-in one, changed by a preset and then field by field by the configured values that are valid."""
    d = DEFAULT_POLICY | PRESETS[preset]
    given = {k: v for k, v in (configured or {}).items() if v is not None}
    if given.get("mode") in MODES:
        d["mode"] = given["mode"]
    if isinstance(given.get("allowed_paths"), list):
        d["allowed_paths"] = [p.strip() for p in given["allowed_paths"] if isinstance(p, str) and p.strip()]
    if isinstance(given.get("allow_external"), bool):
        d["allow_external"] = given["allow_external"]
    for k in ("max_input", "max_output"):
        v = given.get(k)
        if isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) != float("inf") and v == v and v // 1 > 0:
            d[k] = int(v // 1)
    return d


def _path_array(paths: list[str]) -> Column:
    return F.array(*[F.lit(p) for p in paths]).cast("array<string>")


def normalize_policies(per_tool: DataFrame, default: dict | None = None, preset: str = "strict") -> DataFrame:
    """Per field, the tool's value if valid, else the default policy's (see :func:`default_policy`).

    ``per_tool``: ``tool, mode, allowed_paths ARRAY<STRING>, allow_external, max_input, max_output``.
    """
    d = default_policy(default, preset)
    return per_tool.select(
        "tool",
        F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise(F.lit(d["mode"])).alias("mode"),
        F.when(F.col("allowed_paths").isNotNull(), _paths(F.col("allowed_paths"))).otherwise(_path_array(d["allowed_paths"])).alias("allowed_paths"),
        F.coalesce(F.col("allow_external"), F.lit(d["allow_external"])).alias("allow_external"),
        _pos_int(F.col("max_input"), F.lit(d["max_input"]).cast("long")).alias("max_input"),
        _pos_int(F.col("max_output"), F.lit(d["max_output"]).cast("long")).alias("max_output"),
    )


def with_policy(df: DataFrame, tool_col: str, policies: DataFrame, default: dict | None = None, preset: str = "strict") -> DataFrame:
    """Attach each row's policy; tools without one get the default policy.  Policies are one row
    per tool (a small table, joined by key; the planner broadcasts it when its statistics say it is small)."""
    d = default_policy(default, preset)
    p = policies.withColumnRenamed("tool", tool_col)
    j = df.join(p, [tool_col], "left")
    return j.select(
        *df.columns,
        F.coalesce("mode", F.lit(d["mode"])).alias("mode"),
        F.coalesce("allowed_paths", _path_array(d["allowed_paths"])).alias("allowed_paths"),
        F.coalesce("allow_external", F.lit(d["allow_external"])).alias("allow_external"),
        F.coalesce("max_input", F.lit(d["max_input"]).cast("long")).alias("max_input"),
        F.coalesce("max_output", F.lit(d["max_output"]).cast("long")).alias("max_output"),
    )


def gate_rows(df: DataFrame, tool_col: str, native_prefix: str = "native_") -> DataFrame:
    """Allowed if tokenOnly, a native tool (by its prefix), or allow_external; else a reason."""
    allowed = (F.col("mode") == "tokenOnly") | F.col(tool_col).startswith(native_prefix) | F.col("allow_external")
    return df.withColumn("allowed", allowed).withColumn(
        "reason", F.when(allowed, F.lit(None).cast("string")).otherwise(F.lit("external tool not allowed by policy")))


def limit_input(df: DataFrame, payload: Column) -> DataFrame:
    """Serialized payload bytes above ``max_input`` → rejected."""
    return df.withColumn("input_bytes", F.octet_length(payload).cast("long")).withColumn(
        "rejected", F.col("input_bytes") > F.col("max_input"))


def patch_text(text: Column, old: Column, new: Column, replace_all: bool = False) -> Column:
    """D3: struct(status, occurrences, text): not_found / ambiguous / applied."""
    occ = F.when(F.length(old) > 0, ((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)).cast("long")) \
        .otherwise(F.lit(0).cast("long"))
    pos = F.instr(text, old)
    first_only = F.concat(text.substr(F.lit(1), pos - 1), new, text.substr(pos + F.length(old), F.lit(2147483647)))
    applied = F.replace(text, old, new) if replace_all else first_only
    status = F.when(occ == 0, F.lit("not_found")).when((occ > 1) & F.lit(not replace_all), F.lit("ambiguous")) \
        .otherwise(F.lit("applied"))
    out = F.when(status == "applied", applied).otherwise(text)
    return F.struct(status.alias("status"), occ.alias("occurrences"), out.alias("text"))


def _replaced_leaves(df: DataFrame, col: str, pairs: DataFrame, scope: Column, chosen=None, max_chars: int = MAX_CHARS) -> DataFrame:
    """``df`` with ``_new``, a map from each string leaf that is taken to its text with the known strings replaced."""
    dtype = df.schema[col].dataType
    df = df.withColumn("_leaves", F.array_distinct(string_leaves(F.col(col), dtype, chosen)))
    df = replace_known(df, F.col("_leaves"), "_put", pairs, scope, max_chars)
    return df.withColumn("_new", F.map_from_arrays("_leaves", "_put")).drop("_leaves", "_put")


def rehide_nested(df: DataFrame, col: str, vault: DataFrame, scope: Column, max_output: Column, marker: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """Every string leaf of the nested column re-hidden (D2) and then cut to ``max(1, floor(max_output))``
    characters with ``marker`` behind; keys and other leaves are untouched.  All leaves of all rows
    need one pass (or one join) for the vault's values."""
    pairs = vault.select("scope", F.col("value").alias("find"), F.col("token").alias("put"))
    limit = F.greatest(F.lit(1), F.floor(max_output)).cast("int")
    out = _replaced_leaves(df, col, pairs, scope, max_chars=max_chars).withColumn("_limit", limit)
    shown = lambda leaf: F.coalesce(F.try_element_at("_new", leaf), leaf)
    cut = lambda leaf: truncate_text(shown(leaf), F.col("_limit"), marker)
    return out.withColumn(col, map_leaves(F.col(col), df.schema[col].dataType, cut)).drop("_new", "_limit")


def restore_by_policy(df: DataFrame, col: str, vault: DataFrame, scope: Column, max_chars: int = MAX_CHARS) -> DataFrame:
    """Tokens in the nested payload restored as the row's ``mode`` and ``allowed_paths`` (D7) allow:
    ``tokenOnly`` nowhere, ``trusted`` in all string leaves, ``selectiveDeanonymize`` in leaves whose whole path
    a pattern names (``*`` is one segment, an array index is a segment)."""
    pairs = vault.select("scope", F.col("token").alias("find"), F.col("value").alias("put"))
    df = df.withColumn("_paths", path_segments(F.col("allowed_paths")))
    selective = F.col("mode") == "selectiveDeanonymize"
    chosen = lambda path: (F.col("mode") == "trusted") | (selective & path_allowed(F.col("_paths"), path))
    out = _replaced_leaves(df, col, pairs, scope, chosen, max_chars)
    known = lambda leaf: F.coalesce(F.try_element_at("_new", leaf), leaf)
    return out.withColumn(col, map_leaves(F.col(col), df.schema[col].dataType, known, chosen)).drop("_new", "_paths")


def parse_payload(df: DataFrame, col: str, schema, out: str = "payload") -> DataFrame:
    """The JSON text ``col`` as a nested column of ``schema``, and ``reject_reason`` for what is no object.

    Fields that the schema lacks do not pass."""
    kind = F.schema_of_variant(F.try_parse_json(F.col(col)))
    ok = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    return df.withColumn(out, F.when(ok, F.from_json(F.col(col), schema))).withColumn("reject_reason", F.when(~ok, F.lit("payload is not a JSON object")))
