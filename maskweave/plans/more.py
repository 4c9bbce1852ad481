"""Registered queries for the vault life cycle (A6, C10–C13), payloads and policy
(D3, D4, D6–D9), conversations (E1–E3) and time/stream variants (G1–G4)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from maskweave.functions.text import truncate_text
from maskweave.operators import conversations as cv
from maskweave.operators import policy as po
from maskweave.operators import rewrite as rw
from maskweave.operators import scan_text as st
from maskweave.operators import vault as va
from maskweave.plans.common import CORE_RULES, register, ruleset, table
from maskweave.plans.sqlgen import chain_ctes
from maskweave.session import checkpoint_dir
from maskweave.streaming import streams

DOCS_SRC = "SELECT doc_id AS k, doc_id AS o, text FROM documents"


def _anon_docs(spark, sf_dir, scope="default"):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return rw.anonymize(docs, ["doc_id"], ["text"], ruleset(spark, CORE_RULES), scope=scope)


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- vault life


def q_vault_roundtrip(spark, sf_dir):
    res = _anon_docs(spark, sf_dir)
    path = va.save_vault(res.vault, res.counters, _scratch(spark, "vault"), batch_id=0)
    pairs, _counters = va.load_vault(spark, path)
    return pairs.select("value", "token", "idx")


def o_vault_roundtrip():
    return f"WITH {chain_ctes(DOCS_SRC, CORE_RULES)} SELECT value, token, CAST(idx AS BIGINT) AS idx FROM vault"


def q_store_mappings(spark, sf_dir):
    res = _anon_docs(spark, sf_dir)
    v = res.vault
    overrides = v.filter(F.col("idx") % 3 == 0).select(
        "scope", "value", F.concat(F.lit("PINNED_"), F.col("idx").cast("string"), F.lit("_"), F.length("value").cast("string"))
        .alias("token"), F.col("idx").alias("seq"))
    return va.store_mappings(v, overrides).select("value", "token")


def o_store_mappings():
    return (f"WITH {chain_ctes(DOCS_SRC, CORE_RULES)} SELECT value, CASE WHEN idx % 3 = 0 THEN 'PINNED_' || "
            f"CAST(idx AS VARCHAR) || '_' || CAST(length(value) AS VARCHAR) ELSE token END AS token FROM vault")


def q_clear_scope(spark, sf_dir):
    res = _anon_docs(spark, sf_dir, scope=F.col("source"))
    vault, counters = va.clear_scope(res.vault, res.counters, "src0")
    return vault.select("scope", "value", "token")


def o_clear_scope():
    src = "SELECT doc_id AS k, doc_id AS o, text, source AS scope FROM documents"
    return f"WITH {chain_ctes(src, CORE_RULES, scoped=True)} SELECT scope, value, token FROM vault WHERE scope <> 'src0'"


_EDIT = "CASE WHEN doc_id % 10 = 0 THEN concat(text, ' edited') ELSE text END"


def q_incremental_anonymize(spark, sf_dir):
    rules = ruleset(spark, CORE_RULES)
    fp = rw.rules_fingerprint(rules)
    docs = table(spark, sf_dir, "documents")
    done = rw.content_keys(docs.select("doc_id", "text"), ["doc_id"], ["text"], fp)
    register(spark, sf_dir, "documents")
    batch2 = spark.sql(f"SELECT doc_id, {_EDIT} AS text FROM documents")
    todo = rw.changed_rows(batch2, done, ["doc_id"], ["text"], fp)
    res = rw.anonymize(todo, ["doc_id"], ["text"], rules)
    return res.df.select("doc_id", "text", F.col("total_matches").cast("long").alias("total_matches"))


def o_incremental_anonymize():
    src = f"SELECT doc_id AS k, doc_id AS o, {_EDIT} AS text FROM documents WHERE doc_id % 10 = 0"
    return (f"WITH {chain_ctes(src, CORE_RULES)} SELECT src.k AS doc_id, coalesce(rw.text, src.text) AS text, "
            f"CAST(coalesce(rw.n, 0) AS BIGINT) AS total_matches FROM src LEFT JOIN rw ON src.k = rw.k")


def q_quarantine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"))
    ok, rejected = rw.quarantine(docs, "text")
    return rejected.select("doc_id", "reason")


def o_quarantine():
    return "SELECT doc_id, 'null text' AS reason FROM documents WHERE text IS NULL OR doc_id % 7 = 0"


# ------------------------------------------------------------ payload / policy

MARKER = "\n[truncated by output policy]"


def q_truncate_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", truncate_text(F.col("text"), 500, MARKER).alias("text"))


def o_truncate_text():
    return ("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || "
            "'[truncated by output policy]' ELSE text END AS text FROM documents")


_OLD = "CASE WHEN doc_id % 3 = 0 THEN 'the' WHEN doc_id % 3 = 1 THEN 'Und' ELSE 'zzqx' END"


def q_patch_text(spark, sf_dir):
    register(spark, sf_dir, "documents")
    d = spark.sql(f"SELECT doc_id, text, {_OLD} AS old FROM documents")
    p = d.select("doc_id", po.patch_text(F.col("text"), F.col("old"), F.lit("<PATCHED>")).alias("p"))
    return p.select("doc_id", "p.status", "p.occurrences", "p.text")


def o_patch_text():
    occ = "CAST((length(text) - length(replace(text, old, ''))) / length(old) AS BIGINT)"
    return f"""SELECT doc_id, status, occurrences,
  CASE WHEN status = 'applied' THEN substr(text, 1, instr(text, old) - 1) || '<PATCHED>' || substr(text, instr(text, old) + length(old))
       ELSE text END AS text
FROM (SELECT doc_id, text, old, {occ} AS occurrences,
        CASE WHEN {occ} = 0 THEN 'not_found' WHEN {occ} > 1 THEN 'ambiguous' ELSE 'applied' END AS status
      FROM (SELECT doc_id, text, {_OLD} AS old FROM documents))"""


POLICY_SELECT = """
SELECT event_type AS tool,
  CASE event_type WHEN 'click' THEN 'trusted' WHEN 'view' THEN 'selectiveDeanonymize' WHEN 'error' THEN 'bogus' ELSE NULL END AS mode,
  CASE WHEN event_type = 'view' THEN {arr} ELSE NULL END AS allowed_paths,
  CASE WHEN event_type = 'click' THEN true ELSE NULL END AS allow_external,
  CAST(CASE WHEN event_type = 'click' THEN 8.7 WHEN event_type = 'view' THEN -3 ELSE NULL END AS DOUBLE) AS max_input,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 120000.5 END AS DOUBLE) AS max_output
FROM (SELECT DISTINCT event_type FROM events)"""
SPARK_POLICY_SQL = POLICY_SELECT.format(arr="array('a.b', ' ', 'items.*.secret')")
DUCK_POLICY_SQL = POLICY_SELECT.format(arr="['a.b', ' ', 'items.*.secret']")


def _policies(spark, sf_dir):
    register(spark, sf_dir, "events")
    return po.normalize_policies(spark.sql(SPARK_POLICY_SQL))


_O_NORMALIZED = f"""SELECT tool,
  CASE WHEN mode IN ('tokenOnly', 'selectiveDeanonymize', 'trusted') THEN mode ELSE 'tokenOnly' END AS mode,
  coalesce(list_filter(list_transform(allowed_paths, lambda p: trim(p)), lambda p: p <> ''), []) AS allowed_paths,
  coalesce(allow_external, false) AS allow_external,
  CASE WHEN max_input IS NOT NULL AND floor(max_input) > 0 THEN CAST(floor(max_input) AS BIGINT) ELSE 100000 END AS max_input,
  CASE WHEN max_output IS NOT NULL AND floor(max_output) > 0 THEN CAST(floor(max_output) AS BIGINT) ELSE 150000 END AS max_output
FROM ({DUCK_POLICY_SQL})"""


def q_normalize_policies(spark, sf_dir):
    p = _policies(spark, sf_dir)
    return p.select("tool", "mode", F.array_join("allowed_paths", ",").alias("allowed_paths"), "allow_external",
                    "max_input", "max_output")


def o_normalize_policies():
    return (f"SELECT tool, mode, array_to_string(allowed_paths, ',') AS allowed_paths, allow_external, max_input, "
            f"max_output FROM ({_O_NORMALIZED})")


def _events_with_policy(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool"), "props")
    return po.with_policy(ev, "tool", _policies(spark, sf_dir))


def q_gate_rows(spark, sf_dir):
    g = po.gate_rows(_events_with_policy(spark, sf_dir), "tool", native_prefix="sign")
    return g.select("event_id", "tool", "allowed", "reason")


def o_gate_rows():
    return f"""SELECT e.event_id, e.event_type AS tool,
  coalesce(p.mode, 'tokenOnly') = 'tokenOnly' OR starts_with(e.event_type, 'sign') OR coalesce(p.allow_external, false) AS allowed,
  CASE WHEN coalesce(p.mode, 'tokenOnly') = 'tokenOnly' OR starts_with(e.event_type, 'sign') OR coalesce(p.allow_external, false)
       THEN NULL ELSE 'external tool not allowed by policy' END AS reason
FROM events e LEFT JOIN ({_O_NORMALIZED}) p ON e.event_type = p.tool"""


def q_limit_input(spark, sf_dir):
    lim = po.limit_input(_events_with_policy(spark, sf_dir), F.col("props"))
    return lim.select("event_id", "input_bytes", "rejected")


def o_limit_input():
    return f"""SELECT e.event_id, CAST(strlen(e.props) AS BIGINT) AS input_bytes,
  strlen(e.props) > coalesce(p.max_input, 100000) AS rejected
FROM events e LEFT JOIN ({_O_NORMALIZED}) p ON e.event_type = p.tool"""


JSON_RULES = [("two-digit", r"\b\d{2}\b", "N_{index}")]


def q_anonymize_json(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "props")
    res = rw.anonymize(ev, ["event_id"], ["props"], ruleset(spark, JSON_RULES))
    out = rw.reject_unparsable_json(res.df, "props")
    return out.select("event_id", "props", "rejected")


def o_anonymize_json():
    src = "SELECT event_id AS k, event_id AS o, props AS text FROM events"
    return f"""WITH {chain_ctes(src, JSON_RULES)}
SELECT src.k AS event_id, CASE WHEN json_valid(coalesce(rw.text, src.text)) THEN coalesce(rw.text, src.text) END AS props,
       NOT json_valid(coalesce(rw.text, src.text)) AS rejected
FROM src LEFT JOIN rw ON src.k = rw.k"""


# --------------------------------------------------------------- conversations

CONV_SELECT = """
SELECT conv_id, turn, role,
  CASE WHEN role = 'assistant' AND turn % 5 = 3 THEN ''
       ELSE concat(text, ' mail user', cast(conv_id % 50 AS string), '@corp.example.com from 10.1.',
                   cast(turn AS string), '.', cast(conv_id % 200 AS string)) END AS text
FROM conversations"""


def _conv(spark, sf_dir):
    register(spark, sf_dir, "conversations")
    return spark.sql(CONV_SELECT)


def _anon_conv(spark, sf_dir):
    return cv.anonymize_conversations(_conv(spark, sf_dir), ruleset(spark, CORE_RULES))


CONV_SRC = f"SELECT conv_id * 1000 + turn AS k, conv_id * 1000 + turn AS o, text FROM ({CONV_SELECT})"


def q_anonymize_conversations(spark, sf_dir):
    res = _anon_conv(spark, sf_dir)
    return res.df.select("conv_id", "turn", "role", "text", F.col("total_matches").cast("long").alias("total_matches"))


def o_anonymize_conversations():
    return f"""WITH {chain_ctes(CONV_SRC, CORE_RULES)}
SELECT c.conv_id, c.turn, c.role, coalesce(rw.text, c.text) AS text, CAST(coalesce(rw.n, 0) AS BIGINT) AS total_matches
FROM ({CONV_SELECT}) c LEFT JOIN rw ON c.conv_id * 1000 + c.turn = rw.k"""


def q_assemble_transcript(spark, sf_dir):
    res = _anon_conv(spark, sf_dir)
    used = res.spans.select("conv_id", "token").distinct().join(res.vault.select("token", "batch_id", "ord"), "token")
    tokens = used.groupBy("conv_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("batch_id", "ord", "token"))), lambda x: x["token"]), ", ").alias("token_list"))
    return cv.assemble_transcript(res.df.select("conv_id", "turn", "role", "text"), tokens)


def o_assemble_transcript():
    return f"""WITH {chain_ctes(CONV_SRC, CORE_RULES)},
turns AS (SELECT c.conv_id, c.turn, c.role, coalesce(rw.text, c.text) AS text
          FROM ({CONV_SELECT}) c LEFT JOIN rw ON c.conv_id * 1000 + c.turn = rw.k),
toks AS (SELECT conv_id, string_agg(token, ', ' ORDER BY o, -s) AS token_list
         FROM (SELECT DISTINCT tok.k // 1000 AS conv_id, vault.token, vault.o, vault.s FROM tok JOIN vault ON tok.token = vault.token) GROUP BY 1),
body AS (SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS body
         FROM turns WHERE NOT (role = 'assistant' AND coalesce(length(text), 0) = 0) GROUP BY conv_id)
SELECT body.conv_id, CASE WHEN token_list IS NULL THEN body
       ELSE '[active tokens: ' || token_list || ']' || chr(10) || body END AS transcript
FROM body LEFT JOIN toks USING (conv_id)"""


def q_attach_files(spark, sf_dir):
    """Anonymized files behind the anonymized turns, tokens from one vault."""
    conv = _anon_conv(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    anon = rw.anonymize(docs, ["doc_id"], ["text"], ruleset(spark, CORE_RULES), conv.vault, conv.counters, batch_id=1)
    files = anon.df.select((F.col("doc_id") % 200).alias("conv_id"), (F.col("doc_id") % 2).alias("turn"), F.col("doc_id").alias("file_no"),
                           F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text"))
    return cv.attach_files(conv.df, files).select("conv_id", "turn", "text")


def o_attach_files():
    src = f"{CONV_SRC} UNION ALL SELECT 1000000000 + doc_id, 1000000000 + doc_id, text FROM documents"
    return f"""WITH {chain_ctes(src, CORE_RULES)},
files AS (SELECT doc_id % 200 AS conv_id, doc_id % 2 AS turn, string_agg('[Attached file: doc_' || CAST(doc_id AS VARCHAR) || '.txt]' || chr(10) ||
    '```' || chr(10) || coalesce(rw.text, d.text) || chr(10) || '```', chr(10) || chr(10) ORDER BY doc_id) AS body
  FROM documents d LEFT JOIN rw ON rw.k = 1000000000 + d.doc_id GROUP BY 1, 2)
SELECT c.conv_id, c.turn, coalesce(rw.text, c.text) || CASE WHEN f.body IS NULL THEN '' ELSE chr(10) || chr(10) || f.body END AS text
FROM ({CONV_SELECT}) c LEFT JOIN rw ON c.conv_id * 1000 + c.turn = rw.k LEFT JOIN files f ON c.conv_id = f.conv_id AND c.turn = f.turn"""


PARTS_SELECT = """
SELECT conv_id, turn,
  CASE role WHEN 'system' THEN 'binary' WHEN 'assistant' THEN 'tool_call' ELSE 'text' END AS part_kind,
  CASE role WHEN 'assistant' THEN concat('{"turn": ', cast(turn AS string), ', "host": "10.1.', cast(turn AS string), '.',
                                        cast(conv_id % 200 AS string), '", "to": "ops', cast(conv_id % 9 AS string),
                                        '@corp.example.com"}')
            ELSE concat(text, ' from 10.1.', cast(turn AS string), '.', cast(conv_id % 200 AS string)) END AS payload
FROM conversations"""


def q_anonymize_parts(spark, sf_dir):
    register(spark, sf_dir, "conversations")
    parts = spark.sql(PARTS_SELECT).withColumn("part_no", F.lit(0))
    out = cv.anonymize_parts(parts, ruleset(spark, CORE_RULES))
    return out.select("conv_id", "turn", "part_kind", "payload", "rejected")


def o_anonymize_parts():
    src = f"SELECT conv_id * 1000 + turn AS k, conv_id * 1000 + turn AS o, payload AS text FROM ({PARTS_SELECT}) WHERE part_kind <> 'binary'"
    return f"""WITH {chain_ctes(src, CORE_RULES)},
p AS (SELECT c.conv_id, c.turn, c.part_kind, CASE WHEN c.part_kind = 'binary' THEN c.payload ELSE coalesce(rw.text, c.payload) END AS payload
      FROM ({PARTS_SELECT}) c LEFT JOIN rw ON c.conv_id * 1000 + c.turn = rw.k)
SELECT conv_id, turn, part_kind, CASE WHEN part_kind = 'tool_call' AND NOT json_valid(payload) THEN NULL ELSE payload END AS payload,
       part_kind = 'tool_call' AND NOT json_valid(payload) AS rejected FROM p"""


# ----------------------------------------------------------- time and streams

EVENT_TEXT = ("concat(event_type, ' from 10.0.', cast(user_id % 7 AS string), '.', cast(event_id % 5 AS string), "
              "' by u', cast(user_id AS string), '@shop.example.com')")
GAP_MIN = 30


def q_session_tokens(spark, sf_dir):
    register(spark, sf_dir, "events")
    ev = spark.sql(f"SELECT event_id, user_id, ts, {EVENT_TEXT} AS text FROM events")
    sess = streams.sessions(ev, "user_id", "ts", GAP_MIN * 60, ["event_id"])
    res = rw.anonymize(sess, ["event_id"], ["text"], ruleset(spark, CORE_RULES), scope=F.col("session_scope"),
                       order_cols=["event_id"])
    return res.df.select("event_id", "text")


def o_session_tokens():
    src = f"""SELECT event_id AS k, event_id AS o, text, CAST(user_id AS VARCHAR) || ':' || CAST(sess AS VARCHAR) AS scope FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR epoch(ts) - epoch(prev) > {GAP_MIN * 60} THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess
  FROM (SELECT event_id, user_id, ts, {EVENT_TEXT} AS text,
               lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))"""
    return f"""WITH {chain_ctes(src, CORE_RULES, scoped=True)}
SELECT src.k AS event_id, coalesce(rw.text, src.text) AS text FROM src LEFT JOIN rw ON src.k = rw.k"""


def q_windowed_match_stats(spark, sf_dir):
    register(spark, sf_dir, "events")
    ev = spark.sql(f"SELECT event_id, ts, {EVENT_TEXT} AS text FROM events")
    return streams.windowed_match_stats(ev, "event_id", "ts", "text", ruleset(spark, CORE_RULES), "1 hour")


def o_windowed_match_stats():
    src = f"SELECT event_id AS k, event_id AS o, {EVENT_TEXT} AS text FROM events"
    ids = "[" + ", ".join(f"'{r[0]}'" for r in CORE_RULES) + "]"
    return f"""WITH {chain_ctes(src, CORE_RULES)}
SELECT strftime(time_bucket(INTERVAL 1 hour, e.ts), '%Y-%m-%d %H:%M:%S') AS window_start, {ids}[acc.rule + 1] AS rule_id,
       CAST(count(*) AS BIGINT) AS n_matches
FROM acc JOIN events e ON e.event_id = acc.k GROUP BY 1, 2"""


def _event_stream(spark, sf_dir):
    """The events as a folder of files, written in three parts in order of time; a part is a batch."""
    register(spark, sf_dir, "events")
    path = _scratch(spark, "event-files")
    ev = spark.sql(f"SELECT event_id, user_id, cast(ts AS timestamp) AS ts, {EVENT_TEXT} AS text FROM events")
    low, high = ev.agg(F.min("event_id"), F.max("event_id")).first()
    cuts = [low + (high - low + 1) * k // 3 for k in range(4)]
    parts = [ev.filter((F.col("event_id") >= a) & (F.col("event_id") < b)) for a, b in zip(cuts, cuts[1:])]
    # a part has as many files as there are cores, one a task, or one if some could be empty: rows are dealt in
    # turn from each of ``tasks`` input tasks, so one that holds as many rows as there are files fills them all
    files, tasks = spark.sparkContext.defaultParallelism, ev.rdd.getNumPartitions()
    least = min(ev.agg(*[F.count_if((F.col("event_id") >= a) & (F.col("event_id") < b)) for a, b in zip(cuts, cuts[1:])]).first())
    files = files if least > files * tasks else 1
    for part in parts:
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return streams.read_stream(spark, path, files)


def q_stream_session_tokens(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    sdf = _event_stream(spark, sf_dir)
    out = streams.stream_session_tokens(sdf, "user_id", "ts", "event_id", "text", ruleset(spark, CORE_RULES), GAP_MIN * 60)
    return streams.drain(out, _scratch(spark, "stream-sessions")).select(F.col("ord").alias("event_id"), "text")


def q_stream_match_stats(spark, sf_dir):
    out = streams.windowed_match_stats_stream(_event_stream(spark, sf_dir), "ts", "text", ruleset(spark, CORE_RULES), "6 hours", "2 hours", "1 hour")
    return streams.drain(out, _scratch(spark, "stream-stats"))


def o_stream_match_stats():
    """Sliding windows that the watermark (an hour behind the last event) has closed."""
    return f"""WITH e AS (SELECT ts, CASE WHEN n = 1 THEN 'ipv4' ELSE 'email' END AS rule_id FROM events, (VALUES (1), (2)) t(n)),
w AS (SELECT time_bucket(INTERVAL 2 hours, ts) - INTERVAL 2 hours * k AS s, rule_id FROM e, range(3) r(k))
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, rule_id, count(*) AS n_matches FROM w
WHERE s + INTERVAL 6 hours <= (SELECT max(ts) - INTERVAL 1 hour FROM events) GROUP BY 1, 2"""


def q_stream_scan(spark, sf_dir):
    out = streams.stream_scan(spark, f"{sf_dir.rstrip('/')}/documents.parquet", "doc_id", "text",
                              _scratch(spark, "stream-scan"), files_per_batch=None)
    return out.select("doc_id", "value", "source")


def o_stream_scan():
    from maskweave.plans.scans import DOCS_SRC as SDOCS, _o_secrets

    return f"SELECT DISTINCT k AS doc_id, value, source FROM ({_o_secrets(SDOCS)})"


def q_stream_anonymize(spark, sf_dir):
    out = streams.stream_anonymize(spark, f"{sf_dir.rstrip('/')}/documents.parquet", ["doc_id"], "text",
                                   ruleset(spark, CORE_RULES), _scratch(spark, "stream-anon"), files_per_batch=None)
    return out.select("doc_id", "text", F.col("total_matches").cast("long").alias("total_matches"))


def o_stream_anonymize():
    return f"""WITH {chain_ctes(DOCS_SRC, CORE_RULES)}
SELECT d.doc_id, coalesce(rw.text, d.text) AS text, CAST(coalesce(rw.n, 0) AS BIGINT) AS total_matches
FROM documents d LEFT JOIN rw ON d.doc_id = rw.k"""


def q_read_texts(spark, sf_dir):
    from maskweave.sources.files import read_texts, write_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = _scratch(spark, "texts")
    # one text file per document (its path carries the id)
    write_texts(docs, "doc_id", "text", out)
    files = read_texts(spark, out, "*.txt")
    return files.select(F.regexp_extract("path", r"doc_id=([0-9]+)", 1).cast("long").alias("doc_id"), "extension",
                        F.length("content").cast("long").alias("n_chars"))


def o_read_texts():
    # the text writer ends each file with a line separator
    return "SELECT doc_id, '.txt' AS extension, CAST(length(text) + 1 AS BIGINT) AS n_chars FROM documents WHERE text IS NOT NULL"


def q_write_restored(spark, sf_dir):
    from maskweave.sources.files import write_restored

    res = _anon_docs(spark, sf_dir)
    out = _scratch(spark, "restored")
    write_restored(res.df.select("doc_id", F.lit("default").alias("scope"), "text"), res.vault, ["doc_id"], "text", out)
    return spark.read.parquet(out).select("doc_id", "text")


def o_write_restored():
    return "SELECT doc_id, text FROM documents"


QUERIES = {
    "read_texts": (q_read_texts, o_read_texts),
    "write_restored": (q_write_restored, o_write_restored),
    "vault_roundtrip": (q_vault_roundtrip, o_vault_roundtrip),
    "store_mappings": (q_store_mappings, o_store_mappings),
    "clear_scope": (q_clear_scope, o_clear_scope),
    "incremental_anonymize": (q_incremental_anonymize, o_incremental_anonymize),
    "quarantine": (q_quarantine, o_quarantine),
    "truncate_text": (q_truncate_text, o_truncate_text),
    "patch_text": (q_patch_text, o_patch_text),
    "normalize_policies": (q_normalize_policies, o_normalize_policies),
    "gate_rows": (q_gate_rows, o_gate_rows),
    "limit_input": (q_limit_input, o_limit_input),
    "anonymize_json": (q_anonymize_json, o_anonymize_json),
    "anonymize_conversations": (q_anonymize_conversations, o_anonymize_conversations),
    "assemble_transcript": (q_assemble_transcript, o_assemble_transcript),
    "attach_files": (q_attach_files, o_attach_files),
    "anonymize_parts": (q_anonymize_parts, o_anonymize_parts),
    "session_tokens": (q_session_tokens, o_session_tokens),
    "windowed_match_stats": (q_windowed_match_stats, o_windowed_match_stats),
    "stream_session_tokens": (q_stream_session_tokens, o_session_tokens),
    "stream_match_stats": (q_stream_match_stats, o_stream_match_stats),
    "stream_scan": (q_stream_scan, o_stream_scan),
    "stream_anonymize": (q_stream_anonymize, o_stream_anonymize),
}
