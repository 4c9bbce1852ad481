"""Candidate spans, overlap resolution, detection.

All of it is row-local.  The JVM's regular expressions give the matches of every
rule (``regexp_extract_all``) and the text between them (``split``); one Arrow pass per
batch turns these into offsets and resolves overlaps with array operations, so its work is
linear in the matches.  No shuffle is needed and the text never leaves its task.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.patterns import required_literals
from maskweave.functions.ruleset import RuleSet

#: Spans in start order.
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.int32()), ("value", pa.string())]))
SPANS_DDL = "array<struct<start: int, end: int, rule: int, value: string>>"


def _list_parts(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(items of each row, all items, running sum of the items' lengths in code points)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, flat, np.concatenate([[0], np.cumsum(lengths)])


def _offsets(matches: pa.Array, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, start, end, value) of all matches, from the text between them."""
    sizes, values, inside = _list_parts(matches)
    gap_sizes, _, between = _list_parts(pieces)
    row = np.repeat(np.arange(len(sizes)), sizes)
    first, gap_first = np.cumsum(sizes) - sizes, np.cumsum(gap_sizes) - gap_sizes
    at = np.arange(len(row))
    # the leading empty piece is only missing for a match of no length at the text's start
    gaps = at - first[row] + 1 - (gap_sizes == sizes)[row]
    start = between[gap_first[row] + gaps] - between[gap_first[row]] + inside[at] - inside[first[row]]
    return row, start, start + inside[at + 1] - inside[at], values


def _greedy(prio: list[int], start: list[int], end: list[int]) -> list[int]:
    """Kept candidates of one text: by priority, then start; one that overlaps a kept one blocks nothing."""
    starts: list[int] = []
    ends: list[int] = []
    kept: list[int] = []
    for i in sorted(range(len(prio)), key=lambda i: (prio[i], start[i], end[i])):
        at = bisect_left(starts, start[i])
        if (at and ends[at - 1] > start[i]) or (at < len(starts) and starts[at] < end[i]):
            continue
        starts.insert(at, start[i])
        ends.insert(at, end[i])
        kept.append(i)
    return kept


def _spans_of(columns: list[pa.Array], rules: list[tuple[int, int]], resolve: bool) -> pa.Array:
    """The spans of every text from (matches, pieces) of each rule (its number and priority)."""
    found = [_offsets(columns[2 * i], columns[2 * i + 1]) for i in range(len(rules))]
    row, start, end = (np.concatenate([f[k] for f in found]) for k in range(3))
    rule, prio = (np.repeat([r[k] for r in rules], [len(f[0]) for f in found]) for k in range(2))
    order = np.lexsort((rule, end, start, row))
    order = order[end[order] > start[order]]
    if resolve:
        r, s, e = row[order], start[order], end[order]
        clash = np.unique(r[1:][(r[1:] == r[:-1]) & (s[1:] < e[:-1])])  # texts where neighbours overlap
        keep = np.ones(len(order), bool)
        for text in clash.tolist():
            a, b = np.searchsorted(r, [text, text + 1])
            keep[a:b] = False
            keep[a + np.array(_greedy(prio[order[a:b]].tolist(), s[a:b].tolist(), e[a:b].tolist()))] = True
        order = order[keep]
    values = pa.concat_arrays([f[3].cast(pa.string()) for f in found]).take(pa.array(order))
    numbers = [pa.array(c[order], pa.int32()) for c in (start, end, rule)]
    spans = pa.StructArray.from_arrays([*numbers, values], fields=list(SPANS.value_type))
    ends = np.searchsorted(row[order], np.arange(len(columns[0]) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)


def _with_spans(df: DataFrame, text_col: str, rules: RuleSet, out: str, resolve: bool) -> DataFrame:
    if not rules.rules:
        return df.withColumn(out, F.array().cast(SPANS_DDL))
    safe = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")

    def found(regex):
        every, literals = F.regexp_extract_all(safe, F.lit(regex), 0), required_literals(regex)
        if not literals:
            return every
        return F.when(reduce(or_, [safe.contains(x) for x in literals]), every).otherwise(none)

    matches = {f"_m{r.idx}_{out}": found(r.regex) for r in rules.rules}
    df = df.withColumns(matches)
    # without a match the whole text is one piece, which need not travel
    df = df.withColumns({f"_p{r.idx}_{out}": F.when(F.size(f"_m{r.idx}_{out}") > 0, F.split(safe, r.regex, -1)).otherwise(none) for r in rules.rules})
    named = [(r.idx, r.prio) for r in rules.rules]
    spans = F.arrow_udf(lambda *columns: _spans_of(list(columns), named, resolve), SPANS_DDL)
    args = [F.col(f"_{k}{r.idx}_{out}") for r in rules.rules for k in "mp"]
    return df.withColumn(out, spans(*args)).drop(*matches, *[c.replace("_m", "_p", 1) for c in matches])


def find_spans(df: DataFrame, text_col: str, rules: RuleSet, out: str = "spans") -> DataFrame:
    """Every candidate match of every rule, in start order (matches of no length are dropped)."""
    return _with_spans(df, text_col, rules, out, resolve=False)


def detect(df: DataFrame, text_col: str, rules: RuleSet, out: str = "spans") -> DataFrame:
    """Accepted spans of a text, in start order (array<start,end,rule,value>).

    C2 is the greedy acceptance by (priority, start); a rejected span blocks nothing.  Texts in
    which no two neighbours overlap keep all candidates.
    """
    return _with_spans(df, text_col, rules, out, resolve=True)


def rule_lookup(rules: RuleSet, what: str) -> Column:
    """Literal array of a rule attribute, indexed by rule idx with ``F.get``."""
    vals = [getattr(r, what) for r in rules.rules]
    if not vals:
        return F.array().cast(T.ArrayType(T.StringType()))
    return F.array(*[F.lit(v) for v in vals])
