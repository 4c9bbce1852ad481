"""DuckDB oracle SQL built from the same rule texts as the Spark queries.

It takes over the pattern translation and token families of ``functions``, so a wrong
constant there would pass on both sides; matching, allocation and rewriting are its own.
"""

from __future__ import annotations

from maskweave.functions.patterns import rule_to_js
from maskweave.functions.tokens import family_of
from maskweave.plans.common import js_to_re2, sql_str


def oracle_rules(rows) -> list[dict]:
    staged = [(rid, pat, rep) for rid, pat, rep in rows]
    order = sorted(range(len(staged)), key=lambda i: (-len(staged[i][1]), i))
    prio = {i: p for p, i in enumerate(order)}
    out = []
    for i, (rid, pat, rep) in enumerate(staged):
        fam = family_of(rep)
        out.append(
            dict(idx=i, id=rid, pattern=pat, replacement=rep, re2=js_to_re2(rule_to_js(pat)), prio=prio[i],
                 family=fam, kind=fam[0], body=fam[2:])
        )
    return out


def rules_values(rules: list[dict]) -> str:
    rows = ", ".join(
        f"({r['idx']}, {sql_str(r['id'])}, {sql_str(r['pattern'])}, {sql_str(r['replacement'])}, "
        f"{sql_str(r['family'])}, {sql_str(r['kind'])}, {sql_str(r['body'])})"
        for r in rules
    )
    return f"SELECT * FROM (VALUES {rows}) AS t(rule, rule_id, pattern, template, family, kind, body)"


def offsets_expr(text: str, re2: str) -> str:
    """list of {'s': start, 'v': value} for all matches (0-based code points)."""
    rx = sql_str(re2)
    ms = f"regexp_extract_all({text}, {rx})"
    ps = f"string_split_regex({text}, {rx})"
    return (
        f"list_transform(range(len({ms})), lambda i: {{'s': CAST(coalesce(list_sum(list_transform({ps}[1:i + 1], "
        f"lambda x: length(x))), 0) + coalesce(list_sum(list_transform({ms}[1:i], lambda x: length(x))), 0) AS INTEGER), "
        f"'v': {ms}[i + 1]}})"
    )


def candidates_sql(src: str, rules: list[dict]) -> str:
    """src: relation with (k, text) → (k, prio, rule, s, e, v)."""
    parts = []
    for r in rules:
        parts.append(
            f"SELECT k, {r['prio']} AS prio, {r['idx']} AS rule, m.s AS s, CAST(m.s + length(m.v) AS INTEGER) AS e, "
            f"m.v AS v FROM (SELECT k, unnest({offsets_expr('text', r['re2'])}) AS m FROM {src} "
            f"WHERE regexp_matches(text, {sql_str(r['re2'])})) WHERE length(m.v) > 0"
        )
    return "\nUNION ALL\n".join(parts)


def accepted_sql(cand: str) -> str:
    """Greedy by (prio, start); a rejected span blocks nothing."""
    return f"""
SELECT k, a.s AS s, a.e AS e, a.rule AS rule, a.v AS v FROM (
  SELECT k, unnest(list_reduce(
      list({{'prio': prio, 's': s, 'e': e, 'rule': rule, 'v': v}} ORDER BY prio, s),
      lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.s < x.e AND x.s < a.e)) > 0
                          THEN acc ELSE list_append(acc, x) END,
      []::STRUCT(prio INTEGER, s INTEGER, e INTEGER, rule INTEGER, v VARCHAR)[])) AS a
  FROM {cand} GROUP BY k)"""


def token_expr(kind: str, body: str, n: str) -> str:
    return (
        f"CASE WHEN {kind} = 'N' THEN replace({body}, '{{index}}', CAST({n} AS VARCHAR)) "
        f"WHEN {kind} = 'E' THEN 'USER_' || CASE WHEN {n} <= 26 THEN chr(CAST(64 + {n} AS INTEGER)) "
        f"ELSE chr(CAST(64 + ({n} - 1) // 26 AS INTEGER)) || chr(CAST(65 + ({n} - 1) % 26 AS INTEGER)) END || '@domain.tld' "
        f"WHEN {n} > 1 THEN {body} || '_' || CAST({n} AS VARCHAR) ELSE {body} END"
    )


def chain_ctes(src_sql: str, rules_rows, scoped: bool = False) -> str:
    """CTEs: src(k, o, text), rules, cand, acc(k, s, e, rule, v), firsts, vault(value, token, template, idx,
    o, s), tok(k, s, e, rule, v, token), rw(k, text, n)."""
    rules = oracle_rules(rules_rows)
    return f"""
src AS ({src_sql}),
rules AS ({rules_values(rules)}),
cand AS ({candidates_sql('src', rules)}),
acc AS ({accepted_sql('cand')}),
occ AS (SELECT acc.*, src.o, {"src.scope," if scoped else "'' AS scope,"} rules.template, rules.family, rules.kind, rules.body
        FROM acc JOIN src USING (k) JOIN rules USING (rule)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, v ORDER BY o, -s) AS rn FROM occ) WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scope, family ORDER BY o, -s) AS n FROM firsts),
vault AS (SELECT scope, v AS value, {token_expr('kind', 'body', 'n')} AS token, template, n AS idx, o, s FROM ranked),
tok AS (SELECT occ.k, occ.s, occ.e, occ.rule, occ.v, vault.token FROM occ JOIN vault ON occ.v = vault.value
        AND occ.scope = vault.scope),
pieces AS (SELECT tok.*, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS pe,
                  max(e) OVER (PARTITION BY k) AS last_e FROM tok),
rw AS (SELECT p.k, string_agg(substr(src.text, p.pe + 1, p.s - p.pe) || p.token, '' ORDER BY p.s)
                    || substr(any_value(src.text), any_value(p.last_e) + 1) AS text, count(*) AS n
       FROM pieces p JOIN src USING (k) GROUP BY p.k)"""
