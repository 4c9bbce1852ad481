"""Rule tables, set-based over all sheets at once.

Rule rows: ``sheet_id, ordinal, id, type, pattern, replacement, enabled,
description``.  Every operator partitions by ``sheet_id``; nothing loops on
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.text import js_trim

# Rule types.
RULE_TYPES = ["ip", "email", "uuid", "secret", "api-key", "path", "jwt", "private-key", "custom"]
# A replacement must look like a token.
TOKEN_REPLACEMENT_PATTERN = r"^[A-Za-z][A-Za-z0-9_@:\-./{}]*$"

RULE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("replacement", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("description", T.StringType()),
    ]
)
SHEET_SCHEMA = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("rules", T.ArrayType(RULE_SCHEMA)),
        T.StructField("tokenConsistency", T.BooleanType()),
        T.StructField("autoAnonymize", T.BooleanType()),
        T.StructField("showPreview", T.BooleanType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def generated_id(sheet: Column, ordinal: Column) -> Column:
    """Deterministic id for a blank one (the reference uses time + random)."""
    return F.concat(F.lit("rule_"), F.substring(F.sha2(F.concat_ws(":", sheet.cast("string"), ordinal.cast("string")), 256), 1, 16))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.length(js_trim(c)) == 0)


def normalize_rules(rules: DataFrame) -> DataFrame:
    """B1: unknown type → custom, enabled → true, description → '', blank id → generated."""
    return rules.select(
        "sheet_id",
        "ordinal",
        F.when(_blank(F.col("id")), generated_id(F.col("sheet_id"), F.col("ordinal"))).otherwise(F.col("id")).alias("id"),
        F.when(F.col("type").isin(*RULE_TYPES), F.col("type")).otherwise(F.lit("custom")).alias("type"),
        F.coalesce(F.col("pattern"), F.lit("")).alias("pattern"),
        F.coalesce(F.col("replacement"), F.lit("")).alias("replacement"),
        F.coalesce(F.col("enabled"), F.lit(True)).alias("enabled"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
    )


def exportable(rules: DataFrame) -> DataFrame:
    """A2/A3 filter: drop rows whose pattern and replacement are both blank."""
    return rules.filter(~(_blank(F.col("pattern")) & _blank(F.col("replacement"))))


def merge_rules(stored: DataFrame, incoming: DataFrame, mode: str = "merge") -> DataFrame:
    """B2: by (sheet, id), field-wise incoming else stored else default.

    ``merge`` keeps stored rules absent from ``incoming`` (after it, in stored
    order); ``replace`` drops them.  Type must be a known type to count.
    """
    s = stored.select("sheet_id", "id", *[F.col(c).alias(f"s_{c}") for c in
                                           ("ordinal", "type", "pattern", "replacement", "enabled", "description")])
    i = incoming.select("sheet_id", "id", *[F.col(c).alias(f"i_{c}") for c in
                                             ("ordinal", "type", "pattern", "replacement", "enabled", "description")])
    how = "full" if mode == "merge" else "left"
    j = i.join(s, ["sheet_id", "id"], how)
    known = lambda c: F.when(F.col(c).isin(*RULE_TYPES), F.col(c))
    in_incoming = F.col("i_ordinal").isNotNull()
    return j.select(
        "sheet_id",
        F.when(in_incoming, F.struct(F.lit(0).alias("part"), F.col("i_ordinal").alias("o")))
        .otherwise(F.struct(F.lit(1).alias("part"), F.col("s_ordinal").alias("o"))).alias("position"),
        "id",
        F.coalesce(known("i_type"), known("s_type"), F.lit("custom")).alias("type"),
        F.coalesce("i_pattern", "s_pattern", F.lit("")).alias("pattern"),
        F.coalesce("i_replacement", "s_replacement", F.lit("")).alias("replacement"),
        F.coalesce("i_enabled", "s_enabled", F.lit(True)).alias("enabled"),
        F.coalesce("i_description", "s_description", F.lit("")).alias("description"),
    )


def delete_rules(stored: DataFrame, deleted_ids: DataFrame) -> DataFrame:
    """B2 delete: anti-join on (sheet, id)."""
    return stored.join(deleted_ids.select("sheet_id", "id"), ["sheet_id", "id"], "left_anti")


def append_new_rules(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add candidates whose trimmed pattern is new to the sheet; first candidate wins.

    ``candidates`` carry ``sheet_id, seq`` (their order) and the rule fields.
    """
    cand = candidates.withColumn("_tp", js_trim(F.col("pattern")))
    w = Window.partitionBy("sheet_id", "_tp").orderBy("seq")
    first = cand.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    seen = stored.select("sheet_id", js_trim(F.col("pattern")).alias("_tp"))
    new = first.join(seen, ["sheet_id", "_tp"], "left_anti").drop("_tp")
    return new


def active_numbered(rules: DataFrame) -> DataFrame:
    """Active = enabled and not both blank; ``rule_no`` counts active rules per sheet."""
    active = rules.filter(F.coalesce(F.col("enabled"), F.lit(True)) & ~(_blank(F.col("pattern")) & _blank(F.col("replacement"))))
    w = Window.partitionBy("sheet_id").orderBy("ordinal")
    return active.withColumn("rule_no", F.row_number().over(w)).withColumn(
        "tpattern", js_trim(F.coalesce(F.col("pattern"), F.lit("")))
    ).withColumn("treplacement", js_trim(F.coalesce(F.col("replacement"), F.lit(""))))


def validate_rules(rules: DataFrame, pattern_ok: Column | None = None) -> DataFrame:
    """One row per issue ``(sheet_id, rule_no, issue)``.

    ``pattern_ok`` is a boolean Column over ``tpattern`` telling whether the
    pattern compiles (and matches no empty string); by default every non-empty
    pattern is taken as valid.
    """
    a = active_numbered(rules)
    ok = pattern_ok if pattern_ok is not None else F.lit(True)
    issues = F.array(
        F.when(F.col("tpattern") == "", F.lit("pattern is required")),
        F.when((F.col("tpattern") != "") & (F.col("treplacement") == ""), F.lit("replacement is required")),
        F.when((F.col("tpattern") != "") & (F.col("treplacement") != "") & ~F.col("treplacement").rlike(TOKEN_REPLACEMENT_PATTERN),
               F.lit("replacement is invalid")),
        F.when((F.col("tpattern") != "") & ~ok, F.lit("invalid regex")),
    )
    return (
        a.select("sheet_id", "rule_no", F.explode_outer(issues).alias("issue"))
        .filter(F.col("issue").isNotNull())
    )


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """A later rule with the same pattern as the first holder → error when the
    replacement differs, warning when equal.  A window per (sheet, pattern), no self-join."""
    a = active_numbered(rules)
    w = Window.partitionBy("sheet_id", "tpattern").orderBy("rule_no")
    first = a.withColumn("first_no", F.first("rule_no").over(w)).withColumn(
        "first_replacement", F.first("treplacement").over(w))
    later = first.filter(F.col("rule_no") != F.col("first_no"))
    return later.select(
        "sheet_id", "first_no", "rule_no", "tpattern",
        F.when(F.col("treplacement") != F.col("first_replacement"), F.lit("conflict")).otherwise(F.lit("duplicate")).alias("kind"),
    )


def rule_overlap_on_corpus(spans: DataFrame, doc_cols: list[str], bin_width: int = 256) -> DataFrame:
    """Pairs of rules whose candidate spans overlap on real text, with counts.

    Interval self-join per document, binned by ``start div W`` (a span longer
    than W is listed in every bin it covers), so only spans in the same bin are
    compared – never all pairs of a document.
    """
    s = spans.select(*doc_cols, "rule", "start", "end").withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor((F.col("end") - 1) / bin_width))))
    left = s.select(*doc_cols, "bin", F.col("rule").alias("rule_a"), F.col("start").alias("sa"), F.col("end").alias("ea"))
    right = s.select(*doc_cols, "bin", F.col("rule").alias("rule_b"), F.col("start").alias("sb"), F.col("end").alias("eb"))
    pairs = left.join(right, [*doc_cols, "bin"]).filter(
        (F.col("rule_a") < F.col("rule_b")) & (F.col("sa") < F.col("eb")) & (F.col("sb") < F.col("ea"))
        # count a pair once: in the bin where the later start falls
        & (F.col("bin") == F.floor(F.greatest("sa", "sb") / bin_width))
    )
    return pairs.groupBy("rule_a", "rule_b").agg(
        F.count(F.lit(1)).alias("n_overlaps"), F.countDistinct(*doc_cols).alias("n_docs"))


def export_rules(rules: DataFrame, path: str, exported_at: str = "1970-01-01T00:00:00.000Z") -> None:
    """A3: one JSON envelope per sheet ``{version:1, exportedAt, rulesheet, rules}``."""
    ex = exportable(normalize_rules(rules))
    env = ex.groupBy("sheet_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "id", "pattern", "replacement", "type", "enabled", "description"))).alias("r")
    )
    env = env.select(
        "sheet_id",
        F.lit(1).alias("version"),
        F.lit(exported_at).alias("exportedAt"),
        F.col("sheet_id").cast("string").alias("rulesheet"),
        F.transform("r", lambda x: x.dropFields("ordinal")).alias("rules"),
    )
    env.repartition("sheet_id").write.mode("overwrite").partitionBy("sheet_id").json(path)


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc) of whole files: a file is one JSON document, indented or not, or else one document a line."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^\\x{feff}", "").alias("value"))
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    each = F.forall(lines, lambda x: F.trim(x).rlike(r"^[{\[].*[}\]]$") & F.try_parse_json(x).isNotNull())
    docs = files.select("file", F.explode(F.when(each, lines).otherwise(F.array("value"))).alias("doc"))
    return docs.filter(F.trim("doc") != "")


def read_rulesheets(spark: SparkSession, path: str, enabled_only: bool = True) -> DataFrame:
    """A1: sheets (whole JSON files, or one sheet a line); a malformed or ill-typed
    sheet contributes no rules; only enabled rules when ``enabled_only``."""
    schema = T.StructType(SHEET_SCHEMA.fields + [T.StructField("rulesheet", T.StringType())])
    sheet = F.from_json("doc", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    raw = _documents(spark, path).select("file", sheet.alias("sheet")).select("file", "sheet.*")
    good = raw.filter(F.col("_corrupt_record").isNull() & F.col("rules").isNotNull())
    ex = good.select(F.coalesce("rulesheet", "file").alias("sheet_id"), F.posexplode_outer("rules").alias("ordinal", "r")).filter(
        F.col("r").isNotNull())
    rules = normalize_rules(ex.select("sheet_id", "ordinal", "r.*"))
    return rules.filter("enabled") if enabled_only else rules


def import_rules(spark: SparkSession, path: str) -> DataFrame:
    """A2: whole files holding either a bare array of rules or ``{rules: [...]}``, indented or not
    (one envelope per line is also accepted); rows with blank pattern and
    replacement are dropped; defaults as B1."""
    arr_t = T.ArrayType(RULE_SCHEMA)
    obj_t = T.StructType([T.StructField("rules", arr_t), T.StructField("rulesheet", T.StringType())])
    parsed = _documents(spark, path).select(
        "file",
        F.when(F.ltrim("doc").startswith("["), F.from_json("doc", arr_t))
        .otherwise(F.from_json("doc", obj_t)["rules"]).alias("rules"),
        F.from_json("doc", obj_t)["rulesheet"].alias("rulesheet"),
    )
    ex = parsed.select(F.coalesce("rulesheet", "file").alias("sheet_id"), F.posexplode_outer("rules").alias("ordinal", "r")) \
        .filter(F.col("r").isNotNull())
    return exportable(normalize_rules(ex.select("sheet_id", "ordinal", "r.*")))
