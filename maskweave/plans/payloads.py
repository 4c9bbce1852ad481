"""Registered queries for closed failure (C6, C13), unique and forced tokens (C4, C10, D1), re-hiding
and payloads under a policy (D7, D10).  The oracles build the expected text from its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskweave.operators import policy as po
from maskweave.operators import rewrite as rw
from maskweave.operators import vault as va
from maskweave.plans.common import CORE_RULES, register, ruleset, table
from maskweave.plans.sqlgen import chain_ctes

# ------------------------------------------------------------------ C6, C13

FAIL_SELECT = """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 17 = 0 THEN -1 ELSE event_id END AS k,
  CASE WHEN event_id % 13 <> 0 THEN 'all' END AS owner,
  CASE WHEN event_id % 3 = 0 THEN 'nothing here' ELSE concat('from 10.0.', cast(user_id % 7 AS string), '.', cast(event_id % 5 AS string),
    ' by u', cast(user_id % 50 AS string), '@shop.example.com') END AS text
FROM events"""
_REASON = """CASE WHEN owner IS NULL THEN 'null scope' WHEN k IS NULL THEN 'null key'
  WHEN k = -1 AND event_id % 3 <> 0 THEN 'shared key' END"""


def q_anonymize_failclosed(spark, sf_dir):
    register(spark, sf_dir, "events")
    rows = spark.sql(FAIL_SELECT)
    res = rw.anonymize(rows, ["k"], ["text"], ruleset(spark, CORE_RULES), scope=F.col("owner"), order_cols=["event_id"])
    return res.df.select("event_id", "text")


def o_anonymize_failclosed():
    src = f"SELECT event_id AS k, event_id AS o, text FROM ({FAIL_SELECT}) WHERE owner IS NOT NULL AND k IS NOT NULL"
    return f"""WITH {chain_ctes(src, CORE_RULES)}
SELECT e.event_id, CASE WHEN {_REASON.replace(' k ', ' e.k ')} IS NULL THEN coalesce(rw.text, e.text) END AS text
FROM ({FAIL_SELECT}) e LEFT JOIN rw ON rw.k = e.event_id"""


def q_rejects(spark, sf_dir):
    register(spark, sf_dir, "events")
    rows = spark.sql(FAIL_SELECT)
    res = rw.anonymize(rows, ["k"], ["text"], ruleset(spark, CORE_RULES), scope=F.col("owner"), order_cols=["event_id"])
    return res.rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def o_rejects():
    return f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM ({FAIL_SELECT})) WHERE reason IS NOT NULL GROUP BY reason"


# ------------------------------------------------------------ C4, C10, D1

#: A label and a numbered format that print the same tokens.
SHARED_RULES = [("order", r"order \d+", "REF_{index}"), ("clerk", r"clerk \d+", "REF"), ("part", r"part \d+", "PART")]
SHARED_SELECT = """
SELECT l_orderkey * 8 + l_linenumber AS k, concat('order ', cast(l_orderkey % 400 AS string), ' for clerk ',
  cast(l_suppkey % 90 AS string), CASE WHEN l_orderkey % 5 = 0 THEN concat(' part ', cast(l_partkey % 40 AS string)) ELSE '' END) AS text
FROM lineitem"""


def q_token_collisions(spark, sf_dir):
    register(spark, sf_dir, "lineitem")
    lines = spark.sql(SHARED_SELECT)
    res = rw.anonymize(lines.groupBy("k").agg(F.min("text").alias("text")), ["k"], ["text"], ruleset(spark, SHARED_RULES))
    return res.vault.select("value", "token")


def o_token_collisions():
    return f"""WITH lines AS (SELECT k, min(text) AS text FROM ({SHARED_SELECT}) GROUP BY k),
found AS (
  SELECT k, instr(text, 'order') AS s, regexp_extract(text, 'order [0-9]+') AS v, 'N' AS kind, 'REF' AS label FROM lines
  UNION ALL SELECT k, instr(text, 'clerk'), regexp_extract(text, 'clerk [0-9]+'), 'L', 'REF' FROM lines
  UNION ALL SELECT k, instr(text, 'part'), regexp_extract(text, 'part [0-9]+'), 'L', 'PART' FROM lines WHERE contains(text, 'part')),
firsts AS (SELECT v, kind, label, arg_min(s, (k, -s)) AS s, min(k) AS k FROM found GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, kind ORDER BY k, -s) AS own FROM firsts),
numbered AS (SELECT *, row_number() OVER (PARTITION BY label, own = 1 ORDER BY k, -s) AS r FROM ranked)
SELECT v AS value, CASE WHEN own = 1 AND kind = 'L' THEN label WHEN own = 1 THEN label || '_1'
  ELSE label || '_' || CAST(r + 1 AS VARCHAR) END AS token FROM numbered"""


def q_restore_forced(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = ruleset(spark, CORE_RULES)
    first = rw.anonymize(docs, ["doc_id"], ["text"], rules)
    forced = first.vault.filter("idx % 2 = 0").select("scope", "value", F.concat(F.lit("GATEWAY "), F.md5("value")).alias("token"), F.col("idx").alias("seq"))
    vault = va.store_mappings(first.vault, forced, batch_id=1)
    res = rw.anonymize(docs, ["doc_id"], ["text"], rules, vault, first.counters, batch_id=2)
    hidden = res.df.select("doc_id", F.lit("default").alias("scope"), "text", F.regexp_count("text", F.lit("GATEWAY [0-9a-f]{32}")).cast("long").alias("n_forced"))
    return rw.restore(hidden, res.vault, ["doc_id"], "text").select("doc_id", "text", "n_forced")


def o_restore_forced():
    src = "SELECT doc_id AS k, doc_id AS o, text FROM documents"
    return f"""WITH {chain_ctes(src, CORE_RULES)},
forced AS (SELECT tok.k, count(*) AS n FROM tok JOIN vault ON tok.v = vault.value WHERE vault.idx % 2 = 0 GROUP BY 1)
SELECT d.doc_id, d.text, CAST(coalesce(f.n, 0) AS BIGINT) AS n_forced FROM documents d LEFT JOIN forced f ON d.doc_id = f.k"""


# ------------------------------------------------------------------ D2, D5

#: Known are two thirds of the customers, the word that all customers' names hold, and the nations.
KNOWN_SELECT = """
SELECT 'all' AS scope, c_name AS value, concat('CUST_', cast(c_custkey AS string)) AS token FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT 'all', 'Customer', 'WHO'
UNION ALL SELECT 'all', n_name, concat('LAND_', cast(n_nationkey AS string)) FROM nation"""
ORDER_SELECT = """
SELECT o.o_orderkey, c.c_custkey, c.c_name, n.n_name, n.n_nationkey, o.o_orderstatus
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""
_HIDDEN = "CASE WHEN c_custkey % 3 <> 0 THEN concat('CUST_', cast(c_custkey AS VARCHAR)) ELSE replace(c_name, 'Customer', 'WHO') END"


def _orders(spark, sf_dir):
    register(spark, sf_dir, "orders", "customer", "nation")
    return spark.sql(ORDER_SELECT), spark.sql(KNOWN_SELECT)


def q_rehide(spark, sf_dir):
    orders, vault = _orders(spark, sf_dir)
    text = F.concat(F.lit("sent to "), "c_name", F.lit(", "), "c_name", F.lit("x in "), "n_name", F.lit("; no Custome"))
    rows = orders.select("o_orderkey", F.lit("all").alias("scope"), text.alias("text"))
    return rw.rehide(rows, vault, "text").select("o_orderkey", "text")


def q_rehide_joined(spark, sf_dir):
    """The way for vaults of any size, whatever this one's is."""
    orders, vault = _orders(spark, sf_dir)
    text = F.concat(F.lit("sent to "), "c_name", F.lit(", "), "c_name", F.lit("x in "), "n_name", F.lit("; no Custome"))
    rows = orders.select("o_orderkey", F.lit("all").alias("scope"), text.alias("text"))
    return rw.rehide(rows, vault, "text", max_chars=0).select("o_orderkey", "text")


def o_rehide():
    return f"""SELECT o_orderkey, concat('sent to ', {_HIDDEN}, ', ', {_HIDDEN}, 'x in LAND_', CAST(n_nationkey AS VARCHAR), '; no Custome') AS text
FROM ({ORDER_SELECT})"""


MARKER = "\n[cut]"


def _payload(name, nation):
    item = lambda who, n: F.struct(F.lit(n).alias("no"), who.alias("secret"), F.lit("Customer").alias("kind"))
    head = F.struct(F.concat(name, F.lit(" lives in "), nation).alias("text"), F.col("o_orderkey").alias("order"))
    return F.struct(head.alias("head"), F.array(item(name, 1), item(nation, 2)).alias("items"), F.create_map(F.lit("Customer"), name, F.lit("note"), F.lit(None).cast("string")).alias("tags"))


def q_rehide_nested(spark, sf_dir):
    orders, vault = _orders(spark, sf_dir)
    rows = orders.select("o_orderkey", _payload(F.col("c_name"), F.col("n_name")).alias("payload"))
    out = po.rehide_nested(rows, "payload", vault, F.lit("all"), F.lit(14.9), MARKER)
    return out.select("o_orderkey", *_flat())


def _flat():
    p = F.col("payload")
    return [
        p["head"]["text"].alias("head"), p["head"]["order"].alias("head_order"), F.array_join(p["items"]["secret"], "|").alias("secrets"),
        F.array_join(p["items"]["kind"], "|").alias("kinds"), p["tags"]["Customer"].alias("tag"), F.array_join(F.map_keys(p["tags"]), "|").alias("tag_names"),
    ]


def _cut(text: str) -> str:
    return f"CASE WHEN length({text}) > 14 THEN substr({text}, 1, 14) || chr(10) || '[cut]' ELSE {text} END"


def o_rehide_nested():
    land = "concat('LAND_', CAST(n_nationkey AS VARCHAR))"
    head = f"concat({_HIDDEN}, ' lives in ', {land})"
    return f"""SELECT o_orderkey, {_cut(head)} AS head, o_orderkey AS head_order, concat({_cut(_HIDDEN)}, '|', {_cut(land)}) AS secrets,
  'WHO|WHO' AS kinds, {_cut(_HIDDEN)} AS tag, 'Customer|note' AS tag_names FROM ({ORDER_SELECT})"""


# ----------------------------------------------------------------- D7, D10

STATUS_POLICY = """
SELECT 'F' AS tool, 'trusted' AS mode, CAST(NULL AS array<string>) AS allowed_paths, true AS allow_external, CAST(NULL AS double) AS max_input, CAST(NULL AS double) AS max_output
UNION ALL SELECT 'O', 'selectiveDeanonymize', array(' items.*.secret ', 'head', 'tags.Customer.x'), true, NULL, NULL
UNION ALL SELECT 'P', 'bogus', NULL, true, CAST('Infinity' AS double), 0.5"""


def q_restore_by_policy(spark, sf_dir):
    orders, vault = _orders(spark, sf_dir)
    rows = orders.join(vault.withColumnRenamed("value", "c_name").select("c_name", F.col("token").alias("who")), ["c_name"])
    land = F.concat(F.lit("LAND_"), F.col("n_nationkey").cast("string"))
    rows = rows.select("o_orderkey", "o_orderstatus", _payload(F.col("who"), land).alias("payload"))
    policies = po.normalize_policies(spark.sql(STATUS_POLICY))
    out = po.restore_by_policy(po.with_policy(rows, "o_orderstatus", policies), "payload", vault, F.lit("all"))
    return out.select("o_orderkey", *_flat())


def o_restore_by_policy():
    who, land = "concat('CUST_', CAST(c_custkey AS VARCHAR))", "concat('LAND_', CAST(n_nationkey AS VARCHAR))"
    all_, some = "o_orderstatus = 'F'", "o_orderstatus IN ('F', 'O')"
    return f"""SELECT o_orderkey, CASE WHEN {all_} THEN concat(c_name, ' lives in ', n_name) ELSE concat({who}, ' lives in ', {land}) END AS head,
  o_orderkey AS head_order, CASE WHEN {some} THEN concat(c_name, '|', n_name) ELSE concat({who}, '|', {land}) END AS secrets,
  'Customer|Customer' AS kinds, CASE WHEN {all_} THEN c_name ELSE {who} END AS tag, 'Customer|note' AS tag_names
FROM ({ORDER_SELECT}) WHERE c_custkey % 3 <> 0"""


def q_policy_defaults(spark, sf_dir):
    """Events of tools without a policy get the configured default over a preset."""
    ev = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool"))
    given = {"max_input": 77.9, "allowed_paths": [" a.b ", "", 3], "max_output": float("inf")}
    per_tool = spark.sql(STATUS_POLICY.replace("'F' AS", "'click' AS").replace("'P',", "'view',"))
    policies = po.normalize_policies(per_tool, given, "balanced")
    out = po.with_policy(ev, "tool", policies, given, "balanced")
    return out.select("event_id", "mode", F.array_join("allowed_paths", ",").alias("paths"), "allow_external", "max_input", "max_output")


def o_policy_defaults():
    return """SELECT event_id, CASE event_type WHEN 'click' THEN 'trusted' ELSE 'tokenOnly' END AS mode, 'a.b' AS paths,
  event_type IN ('click', 'view') AS allow_external, CAST(77 AS BIGINT) AS max_input, CAST(120000 AS BIGINT) AS max_output FROM events"""


QUERIES = {
    "anonymize_failclosed": (q_anonymize_failclosed, o_anonymize_failclosed),
    "rejects": (q_rejects, o_rejects),
    "token_collisions": (q_token_collisions, o_token_collisions),
    "restore_forced": (q_restore_forced, o_restore_forced),
    "rehide": (q_rehide, o_rehide),
    "rehide_joined": (q_rehide_joined, o_rehide),
    "rehide_nested": (q_rehide_nested, o_rehide_nested),
    "restore_by_policy": (q_restore_by_policy, o_restore_by_policy),
    "policy_defaults": (q_policy_defaults, o_policy_defaults),
}
