"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what the base patterns of the four kinds find.  The two words before an
entity are a lexical pattern, with an empty word for each that the text's start leaves
out; what stands before the entity in its own word counts as one, brackets and quotes
apart.  Instances are identifier-like words, i.e. words with a digit or an at sign, and
runs of digit words that single blanks separate: an instance starts at every word and
goes on as long as the run has at most ``RUN_DIGITS`` digits; a discovered span is its
longest beginning that has the shape of the kind.  Patterns and instances form a bipartite graph that Spark scores round after round:
a pattern's score for a kind is the confidence of its distinct instances over their
number, and an unseen instance's confidence is the chance that one of its patterns is
right.  Patterns with at least ``SUPPORT`` worth of instances and a score of
``CONFIDENT`` discover the unseen identifiers that follow them, if these have the shape
of the kind.  Base spans are never changed.

Positions are code points, the end exclusive.  Work per row is linear in the text but
for the list of its spans, each of which is compared with the identifier-like words.  Graph tables are aggregated by (pattern, value) before they
move, so a pattern or value in a third of the texts is one row per task.

Defined results: null and empty texts have no spans; repeated rows give repeated
results; an empty table gives an empty one; further columns are left out (``mask``
keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import cut, whole_text

#: The base kinds in their order.  The patterns find what the contract's find, and their
#: possessive parts and the look-behind at a run's start keep them linear on long runs.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind that could hold.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
}
_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_DIGIT = f"cast(substring(lpad({_DIGITS}, 19, '0'), 20 - i, 1) AS int)"  # the i-th from the right
HOLDS = {
    "email": "true",
    "ip": r"forall(split(s.value, '\\.'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
    "card": (
        f"length({_DIGITS}) BETWEEN 14 AND 19 AND aggregate(sequence(1, 19), 0, (a, i) -> a + if(i % 2 = 1, {_DIGIT}, "
        f"element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), 1 + {_DIGIT}))) % 10 = 0"
    ),
    "phone": "length(regexp_replace(s.value, '[^0-9]', '')) BETWEEN 10 AND 15",
}
#: An identifier-like word, and what of it is not part of the identifier.
WORDLIKE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
LEADING = "\"'([{<=:"
TRAILING = "\"').,;:!?]}>"
#: A digit word that a further one can follow, and one that can follow; the digits that a run of them may have.
FOLLOWED = r"^[\"'(\[{<=:+]*+[0-9][0-9()./-]*+(?<=[0-9)])$"
FOLLOWING = r"^\(?[0-9][0-9()./-]*+[\"'),;:!?\]}>]*+$"
RUN_DIGITS = 19
#: The last word or two of what stands before a word, with the blanks after them.
LAST_WORDS = r"(?<!\S)\S++(?:\s++\S++)?+\s*+\z"
#: Shape of an unseen identifier by kind.
SHAPES = {
    "email": "value RLIKE '.@.'",
    "ip": "value RLIKE '^[0-9A-Fa-f.:]++$' AND value RLIKE '[0-9]' AND value RLIKE '[.:][0-9A-Fa-f]*+[.:]'",
    "card": "length(regexp_replace(value, '[^0-9]', '')) BETWEEN 12 AND 19",
    "phone": "length(regexp_replace(value, '[^0-9]', '')) BETWEEN 7 AND 15 AND value RLIKE '^[+(]?[0-9][0-9() ./-]*$'",
}
ROUNDS = 3
SUPPORT = 3.0
CONFIDENT = 0.6
#: Matches whose positions are found in one fold.
FOLD = 256
SPAN = "struct<start:int,end:int,value:string,before:string>"
#: Before a base span: what of its word stands before it.  Before a word: the last two words, which the last two matches hold if the gaps do not.
WORD_BEGINNING = r"regexp_extract(_g[i - 1], '(?<!\\S)\\S++\\z', 0)"
WORDS_BEFORE = "regexp_extract(concat_ws('', get(_m, i - 3), get(_g, i - 2), get(_m, i - 2), _g[i - 1]), '" + LAST_WORDS.replace("\\", "\\\\") + "', 0)"


def _found(df: DataFrame, pattern: str, gate: Column, out: str, before: str = WORD_BEGINNING) -> DataFrame:
    """``df`` with the matches of ``pattern`` in ``text`` as structs (start, end, value, before)."""
    empty = F.array().cast("array<string>")
    df = df.withColumn("_gate", gate)
    df = df.withColumn("_m", F.when(F.col("_gate"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split("text", pattern, -1)).otherwise(empty))
    # running positions in two levels, over blocks of matches and inside each, since a fold that collects copies what it has
    n, each = "size(_m)", FOLD
    blocks = f"sequence(0, ({n} - 1) DIV {each})"
    total = lambda x: f"aggregate(slice({x}, b * {each} + 1, {each}), 0, (t, v) -> t + length(v))"
    df = df.withColumn("_b", F.when(F.size("_m") > 0, F.expr(f"transform({blocks}, b -> {total('_g')} + {total('_m')})")))
    df = df.withColumn("_s", F.expr("aggregate(_b, array(0), (s, v) -> concat(s, array(element_at(s, -1) + v)))"))
    inside = (
        f"aggregate(sequence(b * {each} + 1, least({n}, (b + 1) * {each})), struct(_s[b] AS at, cast(array() AS array<{SPAN}>) AS got), (a, i) -> struct("
        "a.at + length(_g[i - 1]) + length(_m[i - 1]) AS at, concat(a.got, array(struct(a.at + length(_g[i - 1]) AS start, "
        f"a.at + length(_g[i - 1]) + length(_m[i - 1]) AS end, _m[i - 1] AS value, {before} AS before))) AS got), a -> a.got)"
    )
    found = F.expr(f"flatten(transform({blocks}, b -> {inside}))")
    return df.withColumn(out, F.when(F.size("_m") > 0, found).otherwise(F.array().cast(f"array<{SPAN}>"))).drop("_gate", "_m", "_g", "_b", "_s")


def with_base_spans(df: DataFrame, out: str = "base") -> DataFrame:
    """``df`` with the base spans of its non-null ``text``: array of (start, ord, end, value, before), sorted."""
    for kind in KINDS:
        df = _found(df, PATTERNS[kind], GATES[kind](F.col("text")), f"_{kind}")
        df = df.withColumn(f"_{kind}", F.expr(f"filter(_{kind}, s -> {HOLDS[kind]})"))
    parts = [F.expr(f"transform(_{k}, s -> struct(s.start AS start, {i} AS ord, s.end AS end, s.value AS value, s.before AS before))") for i, k in enumerate(KINDS)]
    return df.withColumn(out, F.array_sort(F.concat(*parts))).drop(*[f"_{k}" for k in KINDS])


def spans_text(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat({names}[s.ord], ':', cast(s.start AS string), ':', cast(s.end AS string))))")


def _context(before: str, beginning: Column) -> Column:
    """The two words before an identifier, in lower case, with digits alike; ``beginning``: what of its word stands before it."""
    words = F.rtrim(F.regexp_replace(before, r"\s+", " "))
    words = F.when(words.contains(" "), words).otherwise(F.concat(F.lit(" "), words))
    own = F.rtrim(beginning, F.lit(LEADING))
    words = F.when(own == "", words).otherwise(F.concat(F.substring_index(words, " ", -1), F.lit(" "), own))
    return F.regexp_replace(F.lower(words), r"[0-9]+", "0")


def _unseen(words: DataFrame) -> DataFrame:
    """(uid, words without base spans, sorted) → uid, pattern, value, start and heads: (value, end) of its beginnings, the longest first."""
    body = "ltrim('" + LEADING.replace("'", "\\'") + "', w.value)"
    bare = (
        f"struct(w.value AS word, {body} AS body, w.start AS start, w.end AS end, w.before AS before, length(regexp_replace(w.value, '[^0-9]', '')) AS digits, "
        "w.value RLIKE followed AS open, w.value RLIKE following AS more)"
    )
    words = words.withColumn("followed", F.lit(FOLLOWED)).withColumn("following", F.lit(FOLLOWING)).withColumn("trailing", F.lit(TRAILING))
    words = words.withColumn("u", F.expr(f"transform(words, w -> {bare})")).drop("words")
    # ends of the run that starts at a word: a next word must follow the last one's single blank
    goes_on = "a.open AND x.more AND x.start = a.end + 1 AND right(x.before, 1) = ' ' AND a.digits + x.digits <= " + str(RUN_DIGITS)
    step = f"if(a.on AND {goes_on}, struct(true AS on, x.open AS open, x.end AS end, a.digits + x.digits AS digits, concat(array(struct(concat(a.heads[0].text, ' ', x.word) AS text)), a.heads) AS heads), named_struct('on', false, 'open', a.open, 'end', a.end, 'digits', a.digits, 'heads', a.heads))"
    first = "struct(true AS on, w.open AS open, w.end AS end, w.digits AS digits, array(struct(w.body AS text)) AS heads)"
    run = f"if(w.open, aggregate(slice(u, i + 2, {RUN_DIGITS - 1}), {first}, (a, x) -> {step}, a -> a.heads), array(struct(w.body AS text)))"
    words = words.select("uid", "trailing", F.explode(F.expr(f"transform(u, (w, i) -> struct(w.before AS before, w.start + length(w.word) - length(w.body) AS start, {run} AS heads))")).alias("s"))
    words = words.select("uid", _context("s.before", F.lit("")).alias("pattern"), F.col("s.start").alias("start"), F.expr("transform(s.heads, h -> rtrim(trailing, h.text))").alias("texts"))
    heads = F.expr("transform(texts, t -> struct(t AS value, start + length(t) AS end))")
    return words.select("uid", "pattern", F.col("texts")[0].alias("value"), "start", heads.alias("heads"))


def occurrences(found: DataFrame) -> DataFrame:
    """(uid, base, words) → one row per seed or unseen identifier: uid, pattern, value, ord (null: unseen), start, heads (of the unseen)."""
    touched = found.select("uid", F.expr("transform(words, w -> struct(w AS w, filter(base, b -> b.start < w.end AND w.start < b.end) AS spans))").alias("words"))
    # every base span starts in an identifier-like word
    seeds = touched.select("uid", F.explode(F.expr("filter(words, x -> size(x.spans) > 0)")).alias("x")).select(
        "uid", F.col("x.w.before").alias("before"), F.explode(F.expr("filter(x.spans, b -> b.start >= x.w.start)")).alias("s")
    )
    seeds = seeds.select("uid", _context("before", F.col("s.before")).alias("pattern"), F.col("s.value").alias("value"), F.col("s.ord").alias("ord"), F.col("s.start").alias("start"))
    unseen = _unseen(touched.select("uid", F.expr("transform(filter(words, x -> size(x.spans) = 0), x -> x.w)").alias("words")))
    return unseen.withColumn("ord", F.lit(None).cast("int")).unionByName(seeds, allowMissingColumns=True).filter("value <> ''")


def score_patterns(occ: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, ord, score): the patterns that are confident for a kind, after some rounds over the graph."""
    edges = cut(occ.groupBy("pattern", F.xxhash64("value").alias("v")).agg(F.max("ord").alias("ord")), "pii-edges")
    known = edges.filter("ord IS NOT NULL").groupBy("v").agg(F.max("ord").alias("ord")).withColumn("conf", F.lit(1.0))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scored = None
    for i in range(rounds):
        mass = edges.select("pattern", "v").join(known, "v").groupBy("pattern", "ord").agg(F.sum("conf").alias("mass"))
        scored = mass.filter(F.col("mass") >= SUPPORT).join(sizes, "pattern").select("pattern", "ord", (F.col("mass") / F.col("n")).alias("score"))
        scored = cut(scored.filter(F.col("score") >= 0.1), "pii-patterns")
        if i + 1 < rounds:
            fresh = edges.filter("ord IS NULL").select("pattern", "v").join(scored, "pattern").groupBy("v", "ord").agg(
                (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("conf")
            )
            best = fresh.groupBy("v").agg(F.max_by("ord", F.struct("conf", -F.col("ord"))).alias("ord"), F.max("conf").alias("conf"))
            seeds = edges.filter("ord IS NOT NULL").groupBy("v").agg(F.max("ord").alias("ord")).withColumn("conf", F.lit(1.0))
            known = cut(seeds.unionByName(best.join(seeds, "v", "left_anti").select("v", "ord", "conf")), "pii-known")
    return scored.filter(F.col("score") >= CONFIDENT)


def discover(occ: DataFrame, patterns: DataFrame) -> DataFrame:
    """uid → array of discovered spans (start, ord, end) that no base span touches; one that lies in another is left out."""
    shape = "CASE " + " ".join(f"WHEN o = {i} THEN {SHAPES[k].replace('value', 'h.value')}" for i, k in enumerate(KINDS)) + " END"
    best = patterns.groupBy("pattern").agg(F.max_by("ord", F.struct("score", -F.col("ord"))).alias("o"))
    hits = occ.filter("ord IS NULL").drop("ord").join(best, "pattern").withColumn("end", F.expr(f"get(filter(heads, h -> {shape}), 0).end")).filter("end IS NOT NULL")
    more = hits.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", F.col("o").alias("ord"), "end"))).alias("more"))
    # a word of a run starts an instance of its own, so one may end where an earlier one ends
    return more.withColumn("more", F.expr("filter(more, (s, i) -> NOT exists(slice(more, greatest(1, i - 17), least(i, 18)), p -> p.end >= s.end))"))


def detect(texts: DataFrame) -> DataFrame:
    """(uid, text) → uid, base and all spans.  ``uid`` names a text; texts are not null."""
    found = with_base_spans(texts)
    found = _found(found, WORDLIKE, F.col("text").rlike("[0-9@]"), "words", WORDS_BEFORE).drop("text")
    found = cut(found, "pii-found")
    occ = occurrences(found)
    more = discover(occ, score_patterns(occ))
    plain = F.expr("transform(base, s -> struct(s.start AS start, s.ord AS ord, s.end AS end))")
    both = found.select("uid", "base", plain.alias("plain")).join(more, "uid", "left")
    empty = F.array().cast("array<struct<start:int,ord:int,end:int>>")
    return both.select("uid", "base", F.array_sort(F.concat("plain", F.coalesce("more", empty))).alias("spans"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the numbers of base spans by kind, base_sha256 and spans."""
    texts = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("uid"), whole_text().alias("text"))
    found = detect(texts)
    counts = [F.size(F.expr(f"filter(base, s -> s.ord = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("uid.doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """The rows with all their columns, every span in ``text`` replaced by its kind in brackets.

    Overlapping spans are replaced as one, by the kind of the first.  ``n_chars``, where
    the rows have it, is the new length.  Texts move once, by their hash, and only where
    the table of texts with spans is too large to broadcast.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    key = F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    uid = rows.filter("text IS NOT NULL").select(key.alias("uid"), "text")
    spans = detect(uid).filter(F.size("spans") > 0).groupBy("uid").agg(F.first("spans").alias("spans"))
    spans = cut(spans.select(F.col("uid.h").alias("h"), F.col("uid.n").alias("n"), "spans"), "pii-spans")
    joined = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.length("text")).join(spans, ["h", "n"], "left")
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    fold = (
        "aggregate(spans, struct('' AS out, 0 AS at), (a, s) -> if(s.start < a.at, struct(a.out AS out, greatest(a.at, s.end) AS at), "
        f"struct(concat(a.out, substring(text, a.at + 1, s.start - a.at), {names}[s.ord]) AS out, s.end AS at)), "
        "a -> concat(a.out, substring(text, a.at + 1)))"
    )
    joined = joined.withColumn("masked", F.when(F.col("spans").isNotNull(), F.expr(fold)).otherwise(F.col("text")))
    new = {"text": F.col("masked"), "n_chars": F.when(F.col("spans").isNotNull(), F.length("masked")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None)}
    return joined.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
