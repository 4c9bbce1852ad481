"""Registered queries for F8 (IaC scan) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskweave.operators import scan_iac as si
from maskweave.plans import sqltext as sq
from maskweave.plans.common import IAC_SQL, iac_files, js_to_re2, sql_str

_COLS = ["file_id", "id", "pattern", "replacement", "description", "source"]


def _q(kind: str):
    def q(spark, sf_dir):
        files = iac_files(spark, sf_dir)
        rules = si.scan_iac(files, ["file_id"], "name", "content")
        return rules.filter(F.col("source") == kind).select(*_COLS)

    return q


def _lst(vals) -> str:
    return "[" + ", ".join(sql_str(v) for v in vals) + "]"


def _keep_sql(name: str) -> str:
    if name == "cidr":
        return f"NOT list_contains({_lst(si.CIDR_ALLOWLIST)}, v)"
    if name == "account":
        return f"NOT list_contains({_lst(si.PUBLIC_AWS_ACCOUNT_BLOCKLIST)}, v)"
    if name == "db_user":
        return f"NOT list_contains({_lst(si.DB_USER_BLOCKLIST)}, lower(v))"
    if name == "resource":
        toks = f"list_filter(string_split_regex(lower(v), {sql_str('[-_' + sq.WS[1:-1] + ']+')}), lambda t: t <> '')"
        generic = f"(len({toks}) > 0 AND len(list_filter({toks}, lambda t: NOT list_contains({_lst(si.GENERIC_NAME_TOKENS)}, t))) = 0)"
        return (f"length(v) >= 5 AND NOT list_contains({_lst(si.RESOURCE_NAME_VALUE_BLOCKLIST)}, v) "
                f"AND NOT contains(v, '${{') AND NOT {generic}")
    if name == "ami_filter":
        return "contains(v, '/')"
    if name == "ip":
        return ("v NOT IN ('0.0.0.0', '255.255.255.255') AND NOT starts_with(v, '127.') "
                "AND NOT starts_with(v, '169.254.') AND coalesce(suffix, '') = ''")
    return "true"


def _detector_sql(name: str, det: int, src: str) -> str:
    js, flags, _rep, _desc = si.IAC_DETECTORS[name]
    if name == "ip":
        rx = sql_str(js_to_re2(r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b(\/\d)?", flags))
        inner = (f"SELECT k, generate_subscripts(regexp_extract_all(content, {rx}, 1), 1) AS pos, "
                 f"unnest(regexp_extract_all(content, {rx}, 1)) AS v, unnest(regexp_extract_all(content, {rx}, 2)) AS suffix "
                 f"FROM ({src})")
    else:
        rx = sql_str(js_to_re2(js, flags))
        inner = (f"SELECT k, generate_subscripts(regexp_extract_all(content, {rx}, 1), 1) AS pos, "
                 f"unnest(regexp_extract_all(content, {rx}, 1)) AS v FROM ({src})")
    return f"SELECT k, {det} AS det, '{name}' AS name, pos, v FROM ({inner}) WHERE {_keep_sql(name)}"


def _oracle(order: list[str], kind: str, where: str) -> str:
    src = f"SELECT file_id AS k, name, content FROM ({IAC_SQL}) WHERE {where}"
    raw = " UNION ALL ".join(_detector_sql(n, i, src) for i, n in enumerate(order))
    reps = _lst([si.IAC_DETECTORS[n][2] for n in order])
    descs = _lst([si.IAC_DETECTORS[n][3] for n in order])
    return f"""
WITH raw AS ({raw}),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, det, v ORDER BY pos) AS rn FROM raw) WHERE rn = 1),
kept AS (SELECT f.* FROM firsts f WHERE NOT (f.name = 'db_password' AND EXISTS
           (SELECT 1 FROM firsts u WHERE u.name = 'db_user' AND u.k = f.k AND u.v = f.v))),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k, det ORDER BY pos) AS n, {sq.regex_escape('v')} AS pattern FROM kept),
final AS (SELECT *, row_number() OVER (PARTITION BY k, pattern ORDER BY det, n) AS rn2 FROM numbered)
SELECT k AS file_id, 'rule_' || substr(sha256(CAST(k AS VARCHAR) || chr(0) || pattern), 1, 16) AS id, pattern,
       {reps}[det + 1] || '_' || CAST(n AS VARCHAR) AS replacement,
       CASE WHEN name = 'secret' THEN {descs}[det + 1] ELSE {descs}[det + 1] || v END AS description,
       '{kind}' AS source
FROM final WHERE rn2 = 1"""


_TF = "lower(regexp_extract(name, '(\\.[^./\\\\]*)$', 1)) IN ('.tf', '.tfvars')"


def o_terraform():
    return _oracle(si.TERRAFORM_ORDER, "terraform", _TF)


def o_generic():
    return _oracle(si.GENERIC_ORDER, "generic", f"NOT ({_TF})")


QUERIES = {
    "scan_iac_terraform": (_q("terraform"), o_terraform),
    "scan_iac_generic": (_q("generic"), o_generic),
}
