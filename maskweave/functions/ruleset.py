"""Compiled rule sets.

Rules are configuration: a few to a few thousand rows per sheet.  They are read
once per job on the driver (bounded by ``MAX_RULES``) so that every pattern
reaches the executors as a literal and is compiled once per task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.functions.patterns import PatternError, rule_regex
from maskweave.functions.tokens import family_of

MAX_RULES = 5000

# The built-in library rules (id, type, pattern, replacement, description).
BUILTIN_RULES = [
    ("ipv4", "ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP_{index}", "IPv4 addresses"),
    (
        "email",
        "email",
        r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
        "USER_{index}@domain.tld",
        "Email addresses",
    ),
    (
        "ipv6",
        "ip",
        r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|\b(?:[0-9A-Fa-f]{1,4}:){1,7}:\b|\b:(?::[0-9A-Fa-f]{1,4}){1,7}\b",
        "IPV6_{index}",
        "IPv6 addresses",
    ),
    (
        "uuid",
        "uuid",
        r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b",
        "UUID_{index}",
        "UUID values",
    ),
    (
        "api-keys",
        "api-key",
        r"\b(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|AIza[0-9A-Za-z\-_]{35})\b",
        "API_KEY_{index}",
        "Common API key formats (AWS/GitHub/OpenAI/Google)",
    ),
    (
        "jwt",
        "jwt",
        r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
        "JWT_TOKEN_{index}",
        "JWT tokens",
    ),
    (
        "private-key",
        "private-key",
        r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]+?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
        "PRIVATE_KEY_{index}",
        "PEM/OpenSSH private key blocks",
    ),
]


@dataclass(frozen=True)
class CompiledRule:
    idx: int  # position among the enabled rules of the set
    rule_id: str
    pattern: str  # as written (priority uses its length)
    replacement: str
    regex: str  # java.util.regex source
    prio: int  # 0 = tried first: longest pattern, then rule order
    family: str


@dataclass
class RuleSet:
    rules: list[CompiledRule]
    invalid: list[tuple[str, str, str]] = field(default_factory=list)  # (id, pattern, reason)

    @property
    def patterns(self) -> list[str]:
        return [r.pattern for r in self.rules]

    @property
    def templates(self) -> list[str]:
        return [r.replacement for r in self.rules]

    def combined_regex(self) -> str:
        return "|".join(f"(?:{r.regex})" for r in self.rules) or "(?!)"

    @staticmethod
    def from_rows(rows, spark: SparkSession | None = None) -> "RuleSet":
        """rows: iterables of (id, pattern, replacement[, enabled]) in rule order."""
        staged = []
        invalid = []
        rows = list(rows)
        if len(rows) > MAX_RULES:
            raise ValueError(f"rule set too large for literal compilation: {len(rows)} > {MAX_RULES}")
        for row in rows:
            rid, pattern, replacement = row[0], row[1], row[2]
            enabled = row[3] if len(row) > 3 else True
            if enabled is False or pattern is None:
                continue
            try:
                rx = rule_regex(pattern)
            except (PatternError, ValueError) as exc:
                invalid.append((rid, pattern, str(exc)))
                continue
            staged.append((rid, pattern, replacement or "", rx))
        if spark is not None and staged:
            bad = java_invalid(spark, [s[3] for s in staged])
            invalid += [(s[0], s[1], "invalid regex") for i, s in enumerate(staged) if i in bad]
            staged = [s for i, s in enumerate(staged) if i not in bad]
        order = sorted(range(len(staged)), key=lambda i: (-len(staged[i][1]), i))
        prio = {i: p for p, i in enumerate(order)}
        rules = [
            CompiledRule(i, s[0], s[1], s[2], s[3], prio[i], family_of(s[2])) for i, s in enumerate(staged)
        ]
        return RuleSet(rules, invalid)

    @staticmethod
    def from_df(rules_df: DataFrame) -> "RuleSet":
        """Enabled rules of a (normalized) rules table, in ``ordinal`` order."""
        cols = rules_df.columns
        order = [c for c in ("sheet_id", "ordinal") if c in cols]
        sel = rules_df
        if "enabled" in cols:
            sel = sel.filter(F.coalesce(F.col("enabled"), F.lit(True)))
        sel = sel.select("id", "pattern", "replacement", *order)
        if order:
            sel = sel.orderBy(*order)
        if (n := rules_df.count()) > MAX_RULES:  # before anything is dropped, so no rule is ever left out silently
            raise ValueError(f"rule set too large for literal compilation: {n} > {MAX_RULES}")
        rows = sel.collect()
        return RuleSet.from_rows([(r["id"], r["pattern"], r["replacement"]) for r in rows], rules_df.sparkSession)


def builtin_ruleset(spark: SparkSession | None = None, ids: list[str] | None = None) -> RuleSet:
    rows = [(r[0], r[2], r[3]) for r in BUILTIN_RULES if ids is None or r[0] in ids]
    if ids is not None:
        rows.sort(key=lambda r: ids.index(r[0]))
    return RuleSet.from_rows(rows, spark)


def java_invalid(spark: SparkSession, regexes: list[str]) -> set[int]:
    """Indexes of regexes java.util.regex rejects (one tiny job; bisect on failure)."""

    def ok(batch: list[int]) -> bool:
        try:
            spark.range(1).select(
                *[F.regexp_like(F.lit(""), F.lit(regexes[i])).alias(f"c{j}") for j, i in enumerate(batch)]
            ).collect()
            return True
        except Exception:  # noqa: BLE001 - Java compile errors surface as generic errors
            return False

    bad: set[int] = set()
    stack = [list(range(len(regexes)))]
    while stack:
        batch = stack.pop()
        if not batch or ok(batch):
            continue
        if len(batch) == 1:
            bad.add(batch[0])
            continue
        mid = len(batch) // 2
        stack += [batch[:mid], batch[mid:]]
    return bad
