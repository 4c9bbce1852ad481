"""Column expressions for scoring and shaping text values.

Every function takes and returns Columns and stays JVM-side; lambdas only
touch their own variables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskweave.functions.patterns import JS_SPACE_SET, js_to_java

# Generic placeholder values that are never secrets.
GENERIC_VALUE_BLOCKLIST = [
    "password", "pass", "secret", "token", "api_key", "apikey",
    "changeme", "example", "sample", "default", "test", "testing",
    "admin", "root", "postgres", "mysql", "placeholder", "replace_me",
    "your_password", "your_secret", "your_token", "dummy", "todo", "fixme",
    "none", "null", "undefined", "true", "false", "yes", "no", "abc123",
]

# Shapes of infrastructure values (JavaScript source, flags).
INFRASTRUCTURE_VALUE_PATTERNS = [
    (r"^(?:\d{1,3}\.){3}\d{1,3}$", ""),
    (r"^\d{1,3}(?:\.\d{1,3}){3}\/\d{1,2}$", ""),
    (r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", "i"),
    (r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", ""),
    (r"^arn:", "i"),
    (r"^(?:https?:\/\/|ftp:\/\/|file:\/\/)", "i"),
    (r"^(?:~\/|\/|\.\/|\.\.\/).+", ""),
    (r"^(?:var|local|module|data|path|process\.env|env)\.", "i"),
    (r"^\$\{[^}]+\}$", ""),
    (r"^\$\{\{[^}]+\}\}$", ""),
    (r"^[a-z]+-[a-z0-9-]+-\d+$", "i"),
]

# Prefixes of well-known credential formats.
KNOWN_SECRET_PREFIX = (
    r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9_]{30,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,}"
    r"|AIza[0-9A-Za-z\-_]{35}|xox[baprs]-[0-9A-Za-z-]{10,}|(?:sk|pk)_(?:live|test)_[0-9A-Za-z]{24,})$"
)
JWT_SHAPE = r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"
PEM_HEADER = r"^-----BEGIN [A-Z ]+PRIVATE KEY-----"

_SPACES = "".join(c for c in map(chr, range(0x10000)) if re.fullmatch(f"[{JS_SPACE_SET}]", c))


def jrx(src: str, flags: str = "") -> str:
    return js_to_java(src, flags)


def js_trim(c: Column) -> Column:
    """JavaScript ``trim()``: all Unicode spaces and line terminators."""
    return F.btrim(c, F.lit(_SPACES))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def shannon_entropy(c: Column) -> Column:
    """Bits per character: code points counted, divided by the UTF-16 length."""
    chars = F.sort_array(F.split(c, ""))
    init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0.0).alias("acc"))

    def clog(run):
        return F.when(run > 0, run * F.log2(run)).otherwise(F.lit(0.0))

    def step(s, x):
        same = s["prev"].isNotNull() & (s["prev"] == x)
        return F.when(same, F.struct(s["prev"].alias("prev"), (s["run"] + 1).alias("run"), s["acc"].alias("acc"))
                      ).otherwise(F.struct(x.alias("prev"), F.lit(1).alias("run"), (s["acc"] + clog(s["run"])).alias("acc")))

    total = F.aggregate(chars, init, step, lambda s: s["acc"] + clog(s["run"]))
    n = F.size(chars).cast("double")
    L = utf16_length(c).cast("double")
    h = F.log2(L) * n / L - total / L
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(0.0)).otherwise(h)


def char_class_diversity(c: Column) -> Column:
    return (
        c.rlike("[a-z]").cast("int")
        + c.rlike("[A-Z]").cast("int")
        + c.rlike("[0-9]").cast("int")
        + c.rlike("[^a-zA-Z0-9]").cast("int")
    )


def looks_like_infrastructure(trimmed: Column) -> Column:
    out = F.lit(False)
    for src, flags in INFRASTRUCTURE_VALUE_PATTERNS:
        out = out | trimmed.rlike(jrx(src, flags))
    return out


def in_blocklist(lower: Column) -> Column:
    return lower.isin(GENERIC_VALUE_BLOCKLIST)


def with_value(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def is_likely_secret(value: Column, min_length: int = 8) -> Column:
    """the scanner's notion of a secret-looking value."""
    return F.when(value.isNull(), F.lit(False)).otherwise(with_value(js_trim(value), lambda t: _trimmed_secret(t, min_length)))


def _trimmed_secret(t: Column, min_length: int) -> Column:
    n = F.length(t)
    has_ws = t.rlike(f"[{JS_SPACE_SET}]") & ~t.rlike(jrx(PEM_HEADER))
    structured = t.rlike(jrx(r"^[A-Za-z0-9+/_=-]{16,}$"))

    def scored(ent, div):
        long_mixed = (n >= 20) & (div >= 2) & t.rlike("[0-9]")
        return ((div >= 2) & (ent >= 3.2) & structured) | (long_mixed & (ent >= 2.8)) | ((n >= 24) & (div >= 3) & (ent >= 2.6))

    measured = F.struct(shannon_entropy(t).alias("ent"), char_class_diversity(t).alias("div"))
    return (
        F.when(n < min_length, F.lit(False))
        .when(in_blocklist(F.lower(t)) | looks_like_infrastructure(t), F.lit(False))
        .when(has_ws, F.lit(False))
        .when(t.rlike(jrx(JWT_SHAPE)), F.lit(True))
        .when(t.rlike(jrx(KNOWN_SECRET_PREFIX)), F.lit(True))
        .otherwise(with_value(measured, lambda m: scored(m["ent"], m["div"])))
    )


def is_likely_password(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(False)).otherwise(with_value(js_trim(value), _trimmed_password))


def _trimmed_password(t: Column) -> Column:
    return (
        F.when(_trimmed_secret(t, 6), F.lit(True))
        .when(in_blocklist(F.lower(t)) | looks_like_infrastructure(t), F.lit(False))
        .otherwise((F.length(t) >= 10) & (char_class_diversity(t) >= 2) & ~t.rlike("^[a-zA-Z]+$"))
    )


def regex_escape(c: Column) -> Column:
    """a backslash before each of ``.*+?^${}()|[]\\``."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, F.lit("high")).when(c >= 0.55, F.lit("medium")).otherwise(F.lit("low"))


def round2(x: Column) -> Column:
    """JavaScript ``Math.round(x * 100) / 100``."""
    return F.floor(x * 100 + 0.5) / 100


def truncate_text(c: Column, n: int | Column, marker: str = "\n[truncated by output policy]") -> Column:
    """Cut to ``n`` characters and mark; ``n <= 0`` leaves the text as is."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when((n > 0) & (F.length(c) > n), F.concat(c.substr(F.lit(1), n), F.lit(marker))).otherwise(c)


def file_type(name: Column) -> Column:
    """file name → terraform | yaml | json | dotenv | shell | generic."""
    base = F.lower(F.regexp_extract(name, r"([^/\\]*)$", 1))
    ext = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    return (
        F.when(ext.isin(".tf", ".tfvars"), F.lit("terraform"))
        .when(ext.isin(".yaml", ".yml"), F.lit("yaml"))
        .when(ext == ".json", F.lit("json"))
        .when((base == ".env") | base.startswith(".env.") | (ext == ".env"), F.lit("dotenv"))
        .when(ext.isin(".sh", ".bash", ".zsh"), F.lit("shell"))
        .otherwise(F.lit("generic"))
    )
