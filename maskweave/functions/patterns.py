"""Rule patterns → Java regular expressions (driver-side helper, not an operator).

Rules are written for a JavaScript engine.  Spark evaluates ``java.util.regex``;
the two differ on word boundaries, whitespace, ``.``, ``$`` and a few escapes, so
every pattern goes through :func:`js_to_java` once on the driver and reaches the
executors as a string literal (compiled once per task by Spark).
"""

from __future__ import annotations

import re
from re import _constants, _parser

# JavaScript's whitespace set (WhiteSpace + LineTerminator).
JS_SPACE_SET = (
    "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
)
# JavaScript line terminators.
JS_LINE_TERMINATORS = "\\n\\r\\u2028\\u2029"
# JavaScript word characters are ASCII only.
JS_WORD = "A-Za-z0-9_"

WORD_BOUNDARY = f"(?:(?<=[{JS_WORD}])(?![{JS_WORD}])|(?<![{JS_WORD}])(?=[{JS_WORD}]))"
NOT_WORD_BOUNDARY = f"(?:(?<=[{JS_WORD}])(?=[{JS_WORD}])|(?<![{JS_WORD}])(?![{JS_WORD}]))"

_QUANT_BRACE = re.compile(r"\{\d+(?:,\d*)?\}")


_WORD_ONLY_CLASS = re.compile(r"\[(?!\^)((?:[A-Za-z0-9_]-[A-Za-z0-9_]|[A-Za-z0-9_]|\\d|\\w)+)\]")


def _atom_word_only(src: str, i: int) -> tuple[bool, int]:
    """Does the JS atom at ``i`` match only ASCII word characters?  Returns (yes, end)."""
    if i >= len(src):
        return False, i
    ch = src[i]
    if ch == "\\" and i + 1 < len(src):
        return src[i + 1] in "dw", i + 2
    if ch == "[":
        m = _WORD_ONLY_CLASS.match(src, i)
        if m:
            return True, m.end()
        return False, i
    if ch.isascii() and (ch.isalnum() or ch == "_"):
        return True, i + 1
    return False, i


_ENDS_WORD_ONLY = re.compile(
    r"(?:\\[dw]|\[(?!\^)(?:[A-Za-z0-9_]-[A-Za-z0-9_]|[A-Za-z0-9_]|\\[dw])+\]|(?<!\\)[A-Za-z0-9_])"
    r"(?:(?:\+|\{[1-9]\d*(?:,\d*)?\})\??)?$"
)


def _split_top(body: str) -> list[str]:
    parts, depth, cur, i = [], 0, "", 0
    in_class = False
    while i < len(body):
        c = body[i]
        if c == "\\":
            cur += body[i : i + 2]
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(cur)
            cur = ""
            i += 1
            continue
        cur += c
        i += 1
    parts.append(cur)
    return parts


def _starts_word_only(src: str, i: int) -> bool:
    """Every match of ``src[i:]`` begins with an ASCII word character (conservative)."""
    if src.startswith("(?:", i) or (i < len(src) and src[i] == "(" and not src.startswith("(?", i)):
        start = i + (3 if src.startswith("(?:", i) else 1)
        depth, j = 1, start
        while j < len(src) and depth:
            if src[j] == "\\":
                j += 2
                continue
            depth += {"(": 1, ")": -1}.get(src[j], 0)
            j += 1
        if depth:
            return False
        after = src[j : j + 1]
        if after in ("?", "*") or src.startswith("{0", j):
            return False
        return all(alt and _starts_word_only(alt, 0) for alt in _split_top(src[start : j - 1]))
    ok, end = _atom_word_only(src, i)
    if not ok:
        return False
    nxt = src[end : end + 1]
    return not (nxt in ("?", "*") or src.startswith("{0", end))



class PatternError(ValueError):
    """The pattern is not a valid JavaScript regular expression (as far as we translate)."""


# What makes a pattern a regular expression, and what a wildcard pattern means literally.
REGEX_MARKS = re.compile(r"\\[dDsSwWbBtrnvf]|[\[\](){}+|^$]")
WILDCARD_PARTS = re.compile(r"(?P<literal>\\[*?])|(?P<run>\*)|(?P<one>\?)|(?P<special>[\\.^$+{}()|\[\]])")
NOT_BLANK = r"[^\s]"


def is_wildcard(pattern: str) -> bool:
    """It has a free ``*`` or ``?`` and nothing that only a regular expression has."""
    return re.search(r"(?<!\\)[*?]", pattern) is not None and not REGEX_MARKS.search(pattern)


def wildcard_to_js(pattern: str) -> str:
    """``*`` → run of non-spaces, ``?`` → one non-space; ``\\*``/``\\?`` are literal."""
    meaning = {"literal": lambda t: t, "run": lambda t: NOT_BLANK + "*", "one": lambda t: NOT_BLANK, "special": lambda t: "\\" + t}
    return WILDCARD_PARTS.sub(lambda m: meaning[m.lastgroup](m[0]), pattern)


def js_trim(text: str) -> str:
    return re.sub(
        "^[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+|"
        "[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+$",
        "",
        text,
    )


def rule_to_js(pattern: str) -> str:
    """A user rule (wildcard or regex) → JavaScript regex source."""
    trimmed = js_trim(pattern)
    if is_wildcard(trimmed):
        return wildcard_to_js(trimmed)
    return trimmed


def js_to_java(src: str, flags: str = "") -> str:
    """Translate JavaScript regex source (non-unicode mode) to java.util.regex."""
    multiline = "m" in flags
    dotall = "s" in flags
    out: list[str] = []
    i = 0
    n = len(src)
    in_class = False
    class_start = False
    prev_quant = False  # last emitted atom was a quantifier
    depth = 0
    while i < n:
        ch = src[i]
        if ch == "\\":
            if i + 1 >= n:
                raise PatternError("trailing backslash")
            c = src[i + 1]
            i += 2
            prev_quant = False
            class_start = False
            if c == "s":
                out.append(JS_SPACE_SET if in_class else f"[{JS_SPACE_SET}]")
            elif c == "S":
                out.append(f"[^{JS_SPACE_SET}]")
            elif c == "b":
                if in_class:
                    out.append("\\x08")
                elif _starts_word_only(src, i):
                    out.append(f"(?<![{JS_WORD}])")
                elif _ENDS_WORD_ONLY.search(src[: i - 2]):
                    out.append(f"(?![{JS_WORD}])")
                else:
                    out.append(WORD_BOUNDARY)
            elif c == "B":
                out.append("B" if in_class else NOT_WORD_BOUNDARY)
            elif c == "v":
                out.append("\\x0B")
            elif c == "0" and not (i < n and src[i].isdigit()):
                out.append("\\x00")
            elif c in "dDwWtnrf":
                out.append("\\" + c)
            elif c == "c" and i < n and src[i].isalpha():
                out.append("\\c" + src[i])
                i += 1
            elif c == "x" and re.match(r"[0-9A-Fa-f]{2}", src[i : i + 2]):
                out.append("\\x" + src[i : i + 2])
                i += 2
            elif c == "u" and re.match(r"[0-9A-Fa-f]{4}", src[i : i + 4]):
                out.append("\\u" + src[i : i + 4])
                i += 4
            elif c == "k" and not in_class and i < n and src[i] == "<":
                j = src.index(">", i)
                out.append("\\k" + src[i : j + 1])
                i = j + 1
            elif c.isdigit() and not in_class:
                j = i
                while j < n and src[j].isdigit():
                    j += 1
                out.append("\\" + c + src[i:j])
                i = j
            elif c.isalpha():
                # identity escape in JavaScript (non-unicode mode): the letter itself
                out.append(c)
            else:
                out.append("\\" + c)
            continue
        if in_class:
            if ch == "]" and not class_start:
                in_class = False
                out.append("]")
            elif ch == "[":
                out.append("\\[")
            elif ch == "&" and i + 1 < n and src[i + 1] == "&":
                out.append("&\\&")
                i += 1
            elif ch == "]":
                out.append("\\]")
            else:
                out.append(ch)
            class_start = False
            i += 1
            continue
        if ch == "[":
            prev_quant = False
            if src.startswith("[^]", i):
                out.append("(?s:.)")
                i += 3
                continue
            if src.startswith("[]", i):
                out.append("(?!)")
                i += 2
                continue
            in_class = True
            if src.startswith("[^", i):
                out.append("[^")
                i += 2
            else:
                out.append("[")
                i += 1
            class_start = False
            continue
        if ch == "(":
            prev_quant = False
            depth += 1
            if src.startswith("(?", i):
                m = re.match(r"\(\?(?::|=|!|<=|<!|<[A-Za-z_$][\w$]*>)", src[i:])
                if not m:
                    raise PatternError("unsupported group syntax")
                out.append(m.group(0))
                i += len(m.group(0))
            else:
                out.append("(")
                i += 1
            continue
        if ch == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("unbalanced parenthesis")
            out.append(")")
            prev_quant = False
            i += 1
            continue
        if ch in "*+?":
            if ch == "?" and prev_quant is True:
                out.append("?")  # lazy quantifier
                prev_quant = "lazy"
                i += 1
                continue
            if prev_quant or not out or out[-1] in ("(", "|") or out[-1].endswith("(?:"):
                raise PatternError("nothing to repeat")
            out.append(ch)
            prev_quant = True
            i += 1
            continue
        if ch == "{":
            m = _QUANT_BRACE.match(src, i)
            if m:
                if prev_quant or not out:
                    raise PatternError("nothing to repeat")
                out.append(m.group(0))
                prev_quant = True
                i = m.end()
                continue
            out.append("\\{")
            prev_quant = False
            i += 1
            continue
        if ch == "}":
            out.append("\\}")
        elif ch == ".":
            out.append("(?s:.)" if dotall else f"[^{JS_LINE_TERMINATORS}]")
        elif ch == "^":
            out.append(f"(?:\\A|(?<=[{JS_LINE_TERMINATORS}]))" if multiline else "\\A")
        elif ch == "$":
            out.append(f"(?=[{JS_LINE_TERMINATORS}]|\\z)" if multiline else "\\z")
        elif ch == "|":
            out.append("|")
        else:
            out.append(ch)
        prev_quant = False
        i += 1
    if in_class:
        raise PatternError("unterminated character class")
    if depth != 0:
        raise PatternError("unbalanced parenthesis")
    body = "".join(out)
    if "i" in flags:
        body = "(?i)" + body
    return body


def rule_regex(pattern: str) -> str:
    """User rule → Java regex literal; raises :class:`PatternError` when invalid."""
    return js_to_java(rule_to_js(pattern))


def regex_escape_js(value: str) -> str:
    """JavaScript's escapeRegex: backslash before each of ``.*+?^${}()|[]\\``."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", value)


def required_literals(regex: str) -> list[str] | None:
    """Literals of which every match of a Java regex holds at least one: a cheap gate before it runs; None if none is known.

    Read by Python's own parser; what it does not know, ignoring case included, gives no gate."""
    try:
        parsed = _parser.parse(regex)
    except Exception:  # noqa: BLE001 - Java syntax that Python lacks
        return None
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return None
    found = _required(parsed)
    return None if found is None or any("\ud800" <= c <= "\udfff" for x in found for c in x) else found


def _required(items) -> list[str] | None:
    options, run = [], ""
    for op, value in [*items, (None, None)]:
        if op is _constants.LITERAL:
            run += chr(value)
            continue
        if run:
            options.append([run])
            run = ""
        if op is _constants.SUBPATTERN and not value[1] & (re.IGNORECASE | re.VERBOSE):
            options.append(_required(value[3]))
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] >= 1:
            options.append(_required(value[2]))
        elif op is _constants.BRANCH:
            branches = [_required(b) for b in value[1]]
            options.append(None if None in branches else sorted({x for b in branches for x in b}))
    known = [o for o in options if o]
    return max(known, key=lambda o: (min(map(len, o)), -len(o))) if known else None
