"""Registered queries for 2.A (rule sheets) and 2.B (rule tables) with DuckDB oracles.

Rule tables are derived from ``orders`` (stored rules) and ``lineitem``
(incoming / candidate rules) by SQL that both engines run unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.operators import rules as ru
from maskweave.operators import spans as sp
from maskweave.plans.common import CORE_RULES, register, ruleset, table, sql_str
from maskweave.plans.sqlgen import candidates_sql, oracle_rules
from maskweave.session import checkpoint_dir

STORED_SQL = """
SELECT CAST(o_orderkey % 40 AS BIGINT) AS sheet_id,
       CAST(row_number() OVER (PARTITION BY o_orderkey % 40 ORDER BY o_orderkey) AS BIGINT) AS ordinal,
       CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('r', cast(o_orderkey AS string)) END AS id,
       CASE o_orderkey % 7 WHEN 0 THEN 'ip' WHEN 1 THEN 'email' WHEN 2 THEN 'secret' WHEN 3 THEN 'bogus'
            WHEN 4 THEN NULL WHEN 5 THEN 'api-key' ELSE 'custom' END AS type,
       CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN concat('(host', cast(o_custkey % 30 AS string))
            ELSE concat(' host', cast(o_custkey % 30 AS string), '.example.* ') END AS pattern,
       CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN concat('9bad ', cast(o_orderkey % 3 AS string))
            ELSE concat('HOST_', cast(o_orderkey % 3 AS string), '_{index}') END AS replacement,
       CASE WHEN o_orderkey % 5 = 0 THEN false WHEN o_orderkey % 5 = 1 THEN NULL ELSE true END AS enabled,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('order ', cast(o_orderkey AS string)) END AS description
FROM orders
"""

INCOMING_SQL = """
SELECT CAST(l_orderkey % 40 AS BIGINT) AS sheet_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey % 40 ORDER BY l_orderkey) AS BIGINT) AS ordinal,
       concat('r', cast(l_orderkey AS string)) AS id,
       CASE WHEN n % 2 = 0 THEN 'jwt' ELSE NULL END AS type,
       CASE WHEN n >= 5 THEN NULL ELSE concat(' host', cast(p % 45 AS string), '.example.* ') END AS pattern,
       CASE WHEN n = 3 THEN NULL ELSE concat('NEW_', cast(p % 4 AS string), '_{index}') END AS replacement,
       CASE WHEN n = 4 THEN false ELSE NULL END AS enabled,
       CASE WHEN n = 6 THEN concat('line ', cast(p AS string)) ELSE NULL END AS description
FROM (SELECT l_orderkey, max(l_linenumber) AS n, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey)
WHERE n >= 2
"""

TYPES = "[" + ", ".join(sql_str(t) for t in ru.RULE_TYPES) + "]"
WS = "[\\t\\n\\x0B\\f\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def _trim(v: str) -> str:
    return f"regexp_replace({v}, '^{WS}+|{WS}+$', '', 'g')"


def _blank(v: str) -> str:
    return f"({v} IS NULL OR length({_trim(v)}) = 0)"


def _gen_id(sheet: str, ordinal: str) -> str:
    return f"'rule_' || substr(sha256(CAST({sheet} AS VARCHAR) || ':' || CAST({ordinal} AS VARCHAR)), 1, 16)"


def _o_normalized(src: str) -> str:
    return f"""SELECT sheet_id, ordinal,
  CASE WHEN {_blank('id')} THEN {_gen_id('sheet_id', 'ordinal')} ELSE id END AS id,
  CASE WHEN list_contains({TYPES}, type) THEN type ELSE 'custom' END AS type,
  coalesce(pattern, '') AS pattern, coalesce(replacement, '') AS replacement,
  coalesce(enabled, true) AS enabled, coalesce(description, '') AS description FROM ({src})"""


def _stored(spark, sf_dir):
    register(spark, sf_dir, "orders")
    return spark.sql(STORED_SQL)


def _incoming(spark, sf_dir):
    register(spark, sf_dir, "lineitem")
    return spark.sql(INCOMING_SQL)


_RULE_COLS = ["sheet_id", "ordinal", "id", "type", "pattern", "replacement", "enabled", "description"]


# B1
def q_normalize_rules(spark, sf_dir):
    return ru.normalize_rules(_stored(spark, sf_dir)).select(*_RULE_COLS)


def o_normalize_rules():
    return _o_normalized(STORED_SQL)


# B2
def q_merge_rules(spark, sf_dir):
    m = ru.merge_rules(_stored(spark, sf_dir), _incoming(spark, sf_dir), "merge")
    return m.select("sheet_id", F.col("position.part").cast("long").alias("part"),
                    F.col("position.o").cast("long").alias("pos"), "id", "type", "pattern", "replacement", "enabled",
                    "description")


def o_merge_rules():
    known = lambda c: f"CASE WHEN list_contains({TYPES}, {c}) THEN {c} END"
    return f"""SELECT coalesce(i.sheet_id, s.sheet_id) AS sheet_id,
  CAST(CASE WHEN i.ordinal IS NOT NULL THEN 0 ELSE 1 END AS BIGINT) AS part,
  CAST(coalesce(i.ordinal, s.ordinal) AS BIGINT) AS pos, coalesce(i.id, s.id) AS id,
  coalesce({known('i.type')}, {known('s.type')}, 'custom') AS type,
  coalesce(i.pattern, s.pattern, '') AS pattern, coalesce(i.replacement, s.replacement, '') AS replacement,
  coalesce(i.enabled, s.enabled, true) AS enabled, coalesce(i.description, s.description, '') AS description
FROM ({INCOMING_SQL}) i FULL OUTER JOIN ({STORED_SQL}) s ON i.sheet_id = s.sheet_id AND i.id = s.id"""


# B3
def q_append_new_rules(spark, sf_dir):
    cand = _incoming(spark, sf_dir).withColumnRenamed("ordinal", "seq").filter(F.col("pattern").isNotNull())
    new = ru.append_new_rules(_stored(spark, sf_dir), cand)
    return new.select("sheet_id", "seq", "id", "pattern", "replacement")


def o_append_new_rules():
    return f"""SELECT sheet_id, seq, id, pattern, replacement FROM (
  SELECT *, row_number() OVER (PARTITION BY sheet_id, {_trim('pattern')} ORDER BY seq) AS rn
  FROM (SELECT sheet_id, ordinal AS seq, id, pattern, replacement FROM ({INCOMING_SQL}) WHERE pattern IS NOT NULL)) c
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ({STORED_SQL}) s WHERE s.sheet_id = c.sheet_id
                             AND {_trim('s.pattern')} = {_trim('c.pattern')})"""


# B4
def q_validate_rules(spark, sf_dir):
    from maskweave.functions.udfs import pattern_is_valid

    issues = ru.validate_rules(_stored(spark, sf_dir), pattern_is_valid(F.col("tpattern")))
    return issues.select("sheet_id", F.col("rule_no").cast("long").alias("rule_no"), "issue")


def _o_active(src: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY ordinal) AS rule_no,
  {_trim("coalesce(pattern, '')")} AS tp, {_trim("coalesce(replacement, '')")} AS tr
FROM ({src}) WHERE coalesce(enabled, true) AND NOT ({_blank('pattern')} AND {_blank('replacement')})"""


def o_validate_rules():
    tok = sql_str(ru.TOKEN_REPLACEMENT_PATTERN)
    bad = "length(replace(tp, '(', '')) <> length(replace(tp, ')', ''))"
    return f"""SELECT sheet_id, CAST(rule_no AS BIGINT) AS rule_no, issue FROM (
  SELECT sheet_id, rule_no, unnest([
    CASE WHEN tp = '' THEN 'pattern is required' END,
    CASE WHEN tp <> '' AND tr = '' THEN 'replacement is required' END,
    CASE WHEN tp <> '' AND tr <> '' AND NOT regexp_matches(tr, {tok}) THEN 'replacement is invalid' END,
    CASE WHEN tp <> '' AND {bad} THEN 'invalid regex' END]) AS issue
  FROM ({_o_active(STORED_SQL)})) WHERE issue IS NOT NULL"""


# B5
def q_rule_conflicts(spark, sf_dir):
    c = ru.rule_conflicts(_stored(spark, sf_dir))
    return c.select("sheet_id", F.col("first_no").cast("long").alias("first_no"),
                    F.col("rule_no").cast("long").alias("rule_no"), F.col("tpattern").alias("pattern"), "kind")


def o_rule_conflicts():
    return f"""SELECT sheet_id, CAST(first_no AS BIGINT) AS first_no, CAST(rule_no AS BIGINT) AS rule_no, tp AS pattern,
  CASE WHEN tr <> first_r THEN 'conflict' ELSE 'duplicate' END AS kind FROM (
  SELECT *, first_value(rule_no) OVER w AS first_no, first_value(tr) OVER w AS first_r
  FROM ({_o_active(STORED_SQL)}) WINDOW w AS (PARTITION BY sheet_id, tp ORDER BY rule_no))
WHERE rule_no <> first_no"""


# B7
def q_rule_overlap_corpus(spark, sf_dir):
    rules = ruleset(spark, CORE_RULES)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cand = sp.find_spans(docs, "text", rules, "c")
    spans = cand.select("doc_id", F.explode_outer("c").alias("s")).filter(F.col("s").isNotNull()).select(
        "doc_id", "s.rule", "s.start", "s.end")
    out = ru.rule_overlap_on_corpus(spans, ["doc_id"], bin_width=64)
    ids = F.array(*[F.lit(r[0]) for r in CORE_RULES])
    return out.select(F.get(ids, F.col("rule_a")).alias("rule_a"), F.get(ids, F.col("rule_b")).alias("rule_b"),
                      F.col("n_overlaps").cast("long").alias("n_overlaps"), F.col("n_docs").cast("long").alias("n_docs"))


def o_rule_overlap_corpus():
    ids = "[" + ", ".join(sql_str(r[0]) for r in CORE_RULES) + "]"
    return f"""WITH src AS (SELECT doc_id AS k, text FROM documents), cand AS ({candidates_sql('src', oracle_rules(CORE_RULES))})
SELECT {ids}[a.rule + 1] AS rule_a, {ids}[b.rule + 1] AS rule_b, CAST(count(*) AS BIGINT) AS n_overlaps,
       CAST(count(DISTINCT a.k) AS BIGINT) AS n_docs
FROM cand a JOIN cand b ON a.k = b.k AND a.rule < b.rule AND a.s < b.e AND b.s < a.e GROUP BY 1, 2"""


# A1 + A3
def _export(spark, sf_dir) -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/rulesheets-{uuid.uuid4().hex}"
    ru.export_rules(_stored(spark, sf_dir), path)
    return path


def q_read_rulesheets(spark, sf_dir):
    path = _export(spark, sf_dir)
    r = ru.read_rulesheets(spark, path)
    return r.select(F.col("sheet_id").cast("long").alias("sheet_id"), F.col("ordinal").cast("long").alias("ordinal"),
                    "id", "type", "pattern", "replacement", "description")


def _o_exported() -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY ordinal) - 1 AS pos
FROM ({_o_normalized(STORED_SQL)}) WHERE NOT ({_blank('pattern')} AND {_blank('replacement')})"""


def o_read_rulesheets():
    return (f"SELECT sheet_id, CAST(pos AS BIGINT) AS ordinal, id, type, pattern, replacement, description "
            f"FROM ({_o_exported()}) WHERE enabled")


def q_export_rules(spark, sf_dir):
    path = _export(spark, sf_dir)
    raw = spark.read.json(path)
    return raw.select(F.col("sheet_id").cast("long").alias("sheet_id"), F.col("version").cast("long").alias("version"),
                      F.size("rules").cast("long").alias("n_rules"))


def o_export_rules():
    return f"SELECT sheet_id, CAST(1 AS BIGINT) AS version, CAST(count(*) AS BIGINT) AS n_rules FROM ({_o_exported()}) GROUP BY sheet_id"


# A2
def q_import_rules(spark, sf_dir):
    path = _export(spark, sf_dir)
    r = ru.import_rules(spark, path)
    return r.select(F.col("sheet_id").cast("long").alias("sheet_id"), F.col("ordinal").cast("long").alias("ordinal"),
                    "id", "type", "pattern", "replacement", "enabled", "description")


def o_import_rules():
    return (f"SELECT sheet_id, CAST(pos AS BIGINT) AS ordinal, id, type, pattern, replacement, enabled, description "
            f"FROM ({_o_exported()})")


QUERIES = {
    "normalize_rules": (q_normalize_rules, o_normalize_rules),
    "merge_rules": (q_merge_rules, o_merge_rules),
    "append_new_rules": (q_append_new_rules, o_append_new_rules),
    "validate_rules": (q_validate_rules, o_validate_rules),
    "rule_conflicts": (q_rule_conflicts, o_rule_conflicts),
    "rule_overlap_corpus": (q_rule_overlap_corpus, o_rule_overlap_corpus),
    "read_rulesheets": (q_read_rulesheets, o_read_rulesheets),
    "export_rules": (q_export_rules, o_export_rules),
    "import_rules": (q_import_rules, o_import_rules),
}
