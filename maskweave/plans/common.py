"""Shared pieces of the registered queries: tables, injected text, rule sets.

Injected text is written once as SQL that both Spark and DuckDB run unchanged
(``concat``, ``md5``, ``substr``, ``upper``, ``%`` and ``cast(.. as string)``
behave the same in both), so a query and its oracle read identical input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from maskweave.functions.ruleset import BUILTIN_RULES, RuleSet

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


# Log lines built from lineitem: IPv4 (10.0.0.1 in every first line: a hot
# value), mail, cloud keys, code-host tokens, JWTs, UUIDs, DB URLs, assignments.
LOGLINES_SQL = """
SELECT ((l_orderkey * 8 + l_linenumber) * 200003 + l_partkey) * 10007 + l_suppkey AS line_id,
       concat(
         'order=', cast(l_orderkey AS string),
         ' host=10.', cast(l_orderkey % 7 AS string), '.', cast(l_partkey % 250 AS string), '.',
         cast(l_suppkey % 11 + 1 AS string),
         ' user=user', cast(l_partkey % 97 AS string), '@mail', cast(l_suppkey % 9 AS string), '.example.com',
         CASE WHEN l_linenumber = 1 THEN ' gw=10.0.0.1' ELSE '' END,
         CASE WHEN l_orderkey % 5 = 0
              THEN concat(' aws=AKIA', upper(substr(md5(cast(l_orderkey AS string)), 1, 16))) ELSE '' END,
         CASE WHEN l_orderkey % 7 = 0
              THEN concat(' gh=ghp_', md5(cast(l_partkey AS string)), substr(md5(cast(l_suppkey AS string)), 1, 4))
              ELSE '' END,
         CASE WHEN l_linenumber = 2
              THEN concat(' jwt=eyJ', substr(md5(cast(l_orderkey AS string)), 1, 12), '.',
                          md5(cast(l_partkey AS string)), '.', substr(md5(cast(l_suppkey AS string)), 1, 20))
              ELSE '' END,
         CASE WHEN l_linenumber = 3
              THEN concat(' id=', substr(md5(cast(l_partkey AS string)), 1, 8), '-',
                          substr(md5(cast(l_partkey AS string)), 9, 4), '-4',
                          substr(md5(cast(l_partkey AS string)), 13, 3), '-8',
                          substr(md5(cast(l_partkey AS string)), 16, 3), '-',
                          substr(md5(cast(l_partkey AS string)), 19, 12))
              ELSE '' END,
         CASE WHEN l_orderkey % 11 = 0
              THEN concat(' db=postgres://u', cast(l_suppkey AS string), ':',
                          substr(md5(cast(l_orderkey AS string)), 1, 10), '@db', cast(l_orderkey % 5 AS string),
                          '.internal/app')
              ELSE '' END,
         CASE WHEN l_orderkey % 13 = 0
              THEN concat(' client_secret: "', substr(md5(cast(l_partkey AS string)), 1, 10),
                          upper(substr(md5(cast(l_orderkey AS string)), 1, 10)), '"')
              ELSE '' END,
         CASE WHEN l_orderkey % 17 = 0
              THEN concat(' password = "Pw', cast(l_partkey AS string), 'x', substr(md5(cast(l_orderkey AS string)), 1, 6), '"')
              ELSE '' END,
         CASE WHEN l_orderkey % 19 = 0
              THEN concat(' Authorization: Bearer ', substr(md5(cast(l_suppkey AS string)), 1, 12),
                          upper(substr(md5(cast(l_partkey AS string)), 1, 16)))
              ELSE '' END
       ) AS text
FROM lineitem
"""

# Terraform-like blocks built from orders: every IaC detector has something to find.
IAC_SQL = """
SELECT o_orderkey AS file_id,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('main', cast(o_orderkey AS string), '.tf')
            WHEN o_orderkey % 3 = 1 THEN concat('vars', cast(o_orderkey AS string), '.tfvars')
            ELSE concat('notes', cast(o_orderkey AS string), '.txt') END AS name,
       concat(
         'resource "aws_instance" "web" {', chr(10),
         '  ami = "ami-', substr(md5(cast(o_orderkey AS string)), 1, 8), '"', chr(10),
         '  cidr_block = "10.', cast(o_custkey % 200 AS string), '.0.0/16"', chr(10),
         '  allow = "0.0.0.0/0"', chr(10),
         '  region = "', CASE WHEN o_orderkey % 2 = 0 THEN 'us-east-1' ELSE 'eu-west-2' END, '"', chr(10),
         '  owner = "', lpad(cast(o_custkey * 7919 % 1000000000000 AS string), 12, '0'), '"', chr(10),
         '  owners = ["099720109477"]', chr(10),
         '  role = "arn:aws:iam::', lpad(cast(o_custkey AS string), 12, '1'), ':role/app', cast(o_orderkey % 9 AS string), '"', chr(10),
         '  name_filter = "ubuntu/images/hvm-ssd/ubuntu-jammy-22.04-amd64-server-*"', chr(10),
         '  key = file("~/.ssh/deploy', cast(o_custkey % 5 AS string), '.pem")', chr(10),
         '  username = "', CASE WHEN o_orderkey % 4 = 0 THEN 'admin' ELSE concat('svc', cast(o_custkey AS string)) END, '"', chr(10),
         '  password = "', substr(md5(cast(o_custkey AS string)), 1, 9), '"', chr(10),
         '  api_key = "', substr(md5(cast(o_orderkey AS string)), 1, 20), '"', chr(10),
         '  bucket = "logs-', cast(o_custkey % 50 AS string), '-bucket"', chr(10),
         '  tags = {', chr(10), '    Name = "', CASE WHEN o_orderkey % 5 = 0 THEN 'web-server' ELSE concat('billing-', cast(o_custkey % 30 AS string)) END, '"', chr(10), '  }', chr(10),
         '  private_ip = "172.16.', cast(o_custkey % 256 AS string), '.', cast(o_orderkey % 250 + 1 AS string), '"', chr(10),
         '  loopback = "127.0.0.1"', chr(10),
         '}', chr(10)
       ) AS content
FROM orders
"""


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over several tasks a core: a file's row group is one task, however long its rows take."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def loglines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    spread(table(spark, sf_dir, "lineitem").select(*cols)).createOrReplaceTempView("lineitem")
    return spark.sql(LOGLINES_SQL)


def iac_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).createOrReplaceTempView("orders")
    return spark.sql(IAC_SQL)


# --- rule sets used by the registered queries -------------------------------

BUILTIN = {r[0]: r for r in BUILTIN_RULES}

# (id, pattern, replacement): the library's IPv4 and mail rules plus a custom
# wildcard rule that overlaps the mail rule on the real documents.
CORE_RULES = [
    ("ipv4", BUILTIN["ipv4"][2], BUILTIN["ipv4"][3]),
    ("email", BUILTIN["email"][2], BUILTIN["email"][3]),
    ("mailhost", "mail?.example.com", "MAILHOST"),
]
# every library rule, for the injected log lines
LIBRARY_RULES = [(r[0], r[2], r[3]) for r in BUILTIN_RULES]


def ruleset(spark: SparkSession, rows) -> RuleSet:
    return RuleSet.from_rows(rows, spark)


# --- JavaScript pattern → RE2 (for the DuckDB oracles) ----------------------

_RE2_SPACE = (
    "\\t\\n\\x0B\\f\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}"
    "\\x{205f}\\x{3000}\\x{feff}"
)


def js_to_re2(src: str, flags: str = "") -> str:
    """Enough of JavaScript → RE2 for the oracle rule sets (\\b is ASCII in both)."""
    out, i, in_class = [], 0, False
    while i < len(src):
        ch = src[i]
        if ch == "\\" and i + 1 < len(src):
            c = src[i + 1]
            if c == "s":
                out.append(_RE2_SPACE if in_class else "[" + _RE2_SPACE + "]")
            elif c == "S":
                out.append("\\S" if in_class else "[^" + _RE2_SPACE + "]")
            else:
                out.append(src[i : i + 2])
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
            out.append(ch)
        elif ch == "[":
            if src.startswith("[\\s\\S]", i):
                out.append("(?s:.)")
                i += 6
                continue
            in_class = True
            out.append(ch)
        elif ch == "." and "s" not in flags:
            out.append("[^\\n\\r\\x{2028}\\x{2029}]")
        else:
            out.append(ch)
        i += 1
    body = "".join(out)
    prefix = "".join(f for f in flags if f in "im")
    return (f"(?{prefix})" if prefix else "") + body


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
