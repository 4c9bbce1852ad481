"""Token formats as Column expressions.

A *template* is a rule's replacement.  Templates that always produce the same
string for the same number form one *family* and share one counter (that is
what a per-template counter plus the "token already taken" bump yields when
such templates interleave).  The family key says how to print a number:

* ``N:<fmt>``  – every ``{index}`` in ``fmt`` replaced by the number;
* ``E:``       – legacy mail form ``USER_<letters>@domain.tld``;
* ``L:<label>`` – custom label: ``label`` for 1, ``label_n`` after.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legacy type names (matched case-insensitively) and their formats.
LEGACY_FORMATS = {
    "ip": "IP_{index}",
    "api-key": "API_KEY_{index}",
    "uuid": "UUID_{index}",
    "secret": "SECRET_{index}",
    "jwt": "JWT_TOKEN_{index}",
    "private-key": "PRIVATE_KEY_{index}",
    "path": "/PATH_{index}",
}
LEGACY_EMAIL = "email"
EMAIL_PREFIX = "USER_"
EMAIL_SUFFIX = "@domain.tld"


def family_of(template: str) -> str:
    """Driver-side twin of :func:`family_col` (templates come from rules)."""
    if "{index}" in template:
        return "N:" + template
    low = template.lower()
    if low in LEGACY_FORMATS:
        return "N:" + LEGACY_FORMATS[low]
    if low == LEGACY_EMAIL:
        return "E:"
    return "L:" + template


def family_col(template: Column) -> Column:
    low = F.lower(template)
    expr = F.when(template.contains("{index}"), F.concat(F.lit("N:"), template))
    for name, fmt in LEGACY_FORMATS.items():
        expr = expr.when(low == F.lit(name), F.lit("N:" + fmt))
    return expr.when(low == F.lit(LEGACY_EMAIL), F.lit("E:")).otherwise(F.concat(F.lit("L:"), template))


def letters(n: Column) -> Column:
    """1→A … 26→Z, 27→AA … (bijective base 26); 14 letters hold every 64-bit number."""
    init = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))

    def step(acc, _):
        rem = acc["n"] - 1
        return F.when(
            acc["n"] > 0,
            F.struct(
                F.floor(rem / 26).cast("long").alias("n"),
                F.concat(F.char((F.pmod(rem, F.lit(26)) + 65).cast("long")), acc["s"]).alias("s"),
            ),
        ).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), init, step, lambda acc: acc["s"])


def letters_number(word: Column) -> Column:
    """The number that :func:`letters` prints as ``word``."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.when(c == "", 0).otherwise(F.ascii(c) - 64))


def format_token(family: Column, n: Column) -> Column:
    kind = F.substring(family, 1, 2)
    body = F.substring(family, 3, 1 << 30)
    num = n.cast("string")
    return (
        F.when(kind == "N:", F.replace(body, F.lit("{index}"), num))
        .when(kind == "E:", F.concat(F.lit(EMAIL_PREFIX), letters(n), F.lit(EMAIL_SUFFIX)))
        .otherwise(F.when(n > 1, F.concat(body, F.lit("_"), num)).otherwise(body))
    )


def print_token(family: str, n: int) -> str:
    """Python twin of :func:`format_token`, for state that lives outside of columns."""
    kind, body = family[:2], family[2:]
    if kind == "N:":
        return body.replace("{index}", str(n))
    if kind == "E:":
        word = ""
        while n > 0:
            n, rest = divmod(n - 1, 26)
            word = chr(65 + rest) + word
        return EMAIL_PREFIX + word + EMAIL_SUFFIX
    return f"{body}_{n}" if n > 1 else body


def canonical_family(family: Column) -> Column:
    """A label shares its numbers with the format ``label_{index}``: both print ``label_2``."""
    label = family.startswith("L:")
    return F.when(label, F.concat(F.lit("N:"), F.substring(family, 3, 1 << 30), F.lit("_{index}"))).otherwise(family)


def canonical_of(family: str) -> str:
    """Driver-side twin of :func:`canonical_family`."""
    return f"N:{family[2:]}_{{index}}" if family.startswith("L:") else family


def token_number(family: str, token: Column) -> Column:
    """The number with which a canonical family prints ``token``, else null."""
    import re as _re

    if family == "E:":
        word = F.regexp_extract(token, f"^{EMAIL_PREFIX}([A-Z]{{1,13}}){_re.escape(EMAIL_SUFFIX)}$", 1)
        return F.when(word != "", letters_number(word))
    parts = [_re.escape(p) for p in family[2:].split("{index}")]
    shape = "^" + parts[0] + "([1-9][0-9]{0,17})" + "\\1".join(parts[1:]) + "$"
    number = F.regexp_extract(token, shape, 1)
    return F.when(number != "", number.cast("long"))


def overlapping_formats(families: list[str]) -> bool:
    """Whether two canonical families may print the same token: one's text before its number begins the other's."""
    heads = sorted({canonical_of(f) for f in families}, key=lambda f: f[2:])
    heads = sorted(EMAIL_PREFIX if f == "E:" else f[2:].split("{index}")[0] for f in heads)
    return any(b.startswith(a) for a, b in zip(heads, heads[1:]))
