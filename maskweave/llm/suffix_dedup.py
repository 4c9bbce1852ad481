"""Removal of repeated byte strings by a distributed, sampled suffix order.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else.  Such a
string is the lead of a suffix, so equal leads must meet and be told apart from all others:

1. Equal texts are made one, with their number; every copied text goes as a whole.  The texts are
   written once, bucketed by their key, so that later joins do not move them again.
2. The least of a lead's ``TOKEN``-byte tokens by hash (the first one, on ties) is its anchor.
   Suffixes that follow one another and share the anchor travel as one stretch: equal leads have equal
   anchors at equal distances, and a stretch has about LENGTH / 2 suffixes.  Equal stretches of one
   text at equal steps are one row.
3. Only tokens that anchor several places go on.  Stretches with equal bytes are made one, with
   their number: what comes twice is repeated in full.  Tokens with one kind of stretch are settled.
4. The other kinds' bytes are fetched from their first text and dealt by token over ranges whose
   splitters Spark samples, so that equal leads share a bucket.  A bucket sorts the suffixes that
   begin at its anchors by multikey quicksort, eight bytes a level, and likewise the reversed
   bytes before the anchors.  The longest common prefixes of neighbours in both orders tell, for each
   distance to the anchor, which suffixes share their lead.
5. A token with more than ``GROUP`` kinds of stretches would make a bucket too large.  Its suffixes
   are compared across buckets by a 128-bit fingerprint of their leads, counted with a partial
   aggregate; no pairs are formed anywhere.
6. The ranges found go back to all texts that hold the stretches, and the spans are cut.

Texts and stretches are identified by 128 bits of SHA-256 and BLAKE2.  Every group that may hold a
third of all rows (copies, passages, tokens) is reduced by a partial aggregate before it meets.

Defined results: null texts count as empty; texts shorter than ``LENGTH`` stay; equal texts (repeated rows too) count
as many times as they come; a null doc_id stays; very long texts are steps of their own; a string of one
repeated byte is a repeat of itself; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import cut, frugal, mix64, steps
from maskweave.operators.joins import hot_split_join
from maskweave.session import checkpoint_dir

LENGTH = 400
TOKEN = 32
#: Kinds of stretches that a bucket sorts at once.
STEP_STRETCHES = 8192
#: Kinds of stretches of one token beyond which its suffixes are compared across buckets.
GROUP = 16_384
#: A key that holds this share of the rows, or more, is joined apart; so there are at most as many such keys.
HOT_SHARE = 1000
KEY = ["k1", "k2"]
KIND = ["token", "c1", "c2"]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def token_hashes(flat: np.ndarray, size: int = TOKEN) -> np.ndarray:
    """The hash of the ``size`` bytes from every place on."""
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * _powers(_BASE, len(flat)), out=sums[1:])
    n = max(len(flat) - size + 1, 0)
    return mix64((sums[size:] - sums[:n]) * _powers(_INVERSE, n)) if n else np.zeros(0, np.uint64)


def first_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value (the first, on ties) among ``width`` values from every place on."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    blocks = -(-len(values) // width) + 1
    full = np.full(blocks * width, np.uint64(2**64 - 1))
    full[: len(values)] = values
    full = full.reshape(blocks, width)
    place = np.arange(blocks * width).reshape(blocks, width)
    least = np.minimum.accumulate(full, axis=1)
    new = np.ones(full.shape, bool)
    new[:, 1:] = full[:, 1:] < least[:, :-1]
    from_left = np.maximum.accumulate(np.where(new, place, 0), axis=1).ravel()
    least = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1]
    new = full == least  # the first of equal ones replaces later ones
    from_right = np.minimum.accumulate(np.where(new, place, blocks * width)[:, ::-1], axis=1)[:, ::-1].ravel()
    left, right = from_right[:n], from_left[width - 1 : width - 1 + n]
    return np.where(values[left] <= values[right], left, right)


def stretches_of(flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH, token: int = TOKEN) -> tuple[np.ndarray, ...]:
    """(text, first suffix, number of suffixes, anchor, token's hash) of every stretch, places within all texts."""
    hashes = token_hashes(flat, token)
    anchors = first_minima(hashes, length - token + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchors)]
    whole = np.arange(len(anchors)) + length <= offsets[1:][text]  # the lead ends within the text
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (anchors[1:] != anchors[:-1])
    first = np.flatnonzero(new)
    stop = whole & np.append(~whole[1:] | new[1:], True)
    width = np.flatnonzero(stop) - first + 1
    return text[first], first, width, anchors[first], hashes[anchors[first]].view(np.int64)


def progressions(places: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, step, times) of ascending places, equal steps together."""
    i = 0
    while i < len(places):
        step = places[i + 1] - places[i] if i + 1 < len(places) else 0
        j = i + 1
        while j < len(places) and places[j] - places[j - 1] == step:
            j += 1
        yield places[i], step, j - i
        i = j


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sampled(length: int, token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "raw"):
            flat, offsets = _flat(b.column("raw"))
            text, first, width, anchor, hashed = (c.tolist() for c in stretches_of(flat, offsets, length, token))
            data, begins = memoryview(flat.tobytes()), offsets.tolist()
            places: dict[tuple[int, bytes], list[int]] = {}
            kinds: list[tuple[int, int]] = []
            for t, f, w, a, h in zip(text, first, width, anchor, hashed):
                kind = (t, hashlib.blake2b(data[f : f + w + length - 1], digest_size=16).digest())
                have = places.get(kind)
                if have is None:
                    places[kind] = [f - begins[t]]
                    kinds.append((h, w << 10 | a - f))
                else:
                    have.append(f - begins[t])
            rows = [(t, h, c, p << 20 | shape, step << 32 | times) for ((t, c), have), (h, shape) in zip(places.items(), kinds) for p, step, times in progressions(have)]
            which, token_, code, at, again = zip(*rows) if rows else [()] * 5
            c = np.frombuffer(b"".join(code), np.int64).reshape(-1, 2)
            own = [b.column(k).take(pa.array(which, pa.int64())) for k in (*KEY, "copied")]
            columns = [*own, pa.array(token_, pa.int64()), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(at, pa.int64()), pa.array(again, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "copied", *KIND, "at", "again"])

    return run


def quicksort(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of the rows by group, then word by word; only rows that are still equal go to the next level."""
    order = np.argsort(group, kind="stable")
    part = np.searchsorted(group[order], group[order])  # where the part of equal rows begins
    open_ = np.arange(len(order))
    for level in range(words.shape[1]):
        sizes = np.bincount(part, minlength=len(order))
        open_ = open_[sizes[part[open_]] > 1]
        if not len(open_):
            break
        key = words[order[open_], level]
        by = np.lexsort((key, part[open_]))
        order[open_], key = order[open_][by], key[by]
        new = np.ones(len(open_), bool)
        new[1:] = (part[open_][1:] != part[open_][:-1]) | (key[1:] != key[:-1])
        part[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
    return order


def common_prefixes(rows: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Equal bytes of each row in order and the one before it; -1 where a group begins."""
    differ = rows[order[1:]] != rows[order[:-1]]
    out = np.full(len(order), -1)
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    out[1:][group[order[1:]] != group[order[:-1]]] = -1
    return out


def repeated_suffixes(group: np.ndarray, contents: list[bytes], before: np.ndarray, width: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Per stretch (row) and distance to its anchor (column), whether another stretch of the group has the same lead there.

    ``before`` is the number of suffixes before the anchor's, ``width`` that of suffixes.
    """
    size = -(-length // 8) * 8
    m = len(contents)
    flat = np.frombuffer(b"".join([*contents, bytes(size)]), np.uint8)
    ends = np.cumsum([len(c) for c in contents])
    anchor = ends - [len(c) for c in contents] + before
    step = np.arange(size)
    right = np.lib.stride_tricks.sliding_window_view(flat, size)[anchor] * (step < (ends - anchor)[:, None])
    turned = np.concatenate([flat[: ends[-1]][::-1], np.zeros(size, np.uint8)])
    left = np.lib.stride_tricks.sliding_window_view(turned, size)[ends[-1] - anchor] * (step < before[:, None])
    orders = [quicksort(np.ascontiguousarray(x).view(">u8").astype(np.uint64), group) for x in (right, left)]
    common = [common_prefixes(x, group, o) for x, o in zip((right, left), orders)]
    out = np.zeros((m, int(before.max()) + 1), bool)
    same = np.empty((2, m), np.int64)
    for distance in range(out.shape[1]):
        here = np.flatnonzero((distance <= before) & (distance > before - width))
        if len(here) < 2:
            continue
        for k, depth in ((0, length - distance), (1, distance)):
            same[k, orders[k]] = np.cumsum(common[k] < depth)
        pair = same[0, here] * (m + 1) + same[1, here]
        by = np.argsort(pair)
        equal = pair[by[1:]] == pair[by[:-1]]
        hit = np.append(equal, False) | np.append(False, equal)
        out[here[by[hit]], distance] = True
    return out


def _ranges(hits: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hits.astype(np.int8), [0]])))
    return [{"a": a, "b": b} for a, b in edges.reshape(-1, 2).tolist()]


RANGES = "token long, c1 long, c2 long, ranges array<struct<a: int, b: int>>"
RANGE_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_bucket(length: int, at_once: int):
    """Rows come sorted by token; whole tokens are compared, many at a time."""

    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        token, shape = rows["token"].to_numpy(), rows["at"].to_numpy() & ((1 << 20) - 1)
        before, width = shape & 1023, shape >> 10
        hits = repeated_suffixes(np.unique(token, return_inverse=True)[1], rows["content"].to_pylist(), before, width, length)
        # the suffix at distance d is the stretch's suffix before - d
        found = [_ranges(hits[i, max(b - w + 1, 0) : b + 1][::-1]) for i, (b, w) in enumerate(zip(before.tolist(), width.tolist()))]
        columns = [rows[k].combine_chunks() for k in KIND]
        return pa.RecordBatch.from_arrays([*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns), pa.array(found, RANGE_TYPE)], [*KIND, "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                some = b.slice(at, at_once)
                token = some.column("token").to_numpy()
                cut_at = int(np.searchsorted(token, token[-1]))  # the last token may go on in the next rows
                if held and n + cut_at >= at_once and (cut_at or held[-1].column("token")[-1].as_py() != int(token[0])):
                    yield compare([*held, some.slice(0, cut_at)] if cut_at else held)
                    held, n, some = [], 0, some.slice(cut_at)
                held.append(some)
                n += some.num_rows
        if held:
            yield compare(held)

    return run


def _leads(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                leads, which, place = [], [], []
                for i, (content, shape) in enumerate(zip(some.column("content").to_pylist(), some.column("at").to_pylist())):
                    width = (shape & ((1 << 20) - 1)) >> 10
                    leads += [hashlib.blake2b(content[j : j + length], digest_size=16).digest() for j in range(width)]
                    which += [i] * width
                    place += range(width)
                f = np.frombuffer(b"".join(leads), np.int64).reshape(-1, 2)
                kind = [some.column(k).take(pa.array(which, pa.int64())) for k in KIND]
                yield pa.RecordBatch.from_arrays([*kind, pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(place, pa.int32())], [*KIND, "f1", "f2", "place"])

    return run


def _spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(iter([batch]), "raw"):
                spans, kept = [], []
                for raw, marks in zip(b.column("raw").to_pylist(), b.column("marks").to_pylist()):
                    edge = np.zeros(len(raw) + 1, np.int64)
                    for m in marks:
                        first = (m["at"] >> 20) + (m["again"] >> 32) * np.arange(m["again"] & 0xFFFFFFFF)
                        for r in m["ranges"]:
                            np.add.at(edge, first + r["a"], 1)
                            np.add.at(edge, first + r["b"] - 1 + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans.append(_ranges(gone))
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEY), pa.array(spans, RANGE_TYPE), pa.array(kept, pa.binary())], [*KEY, "spans", "kept"])

    return run


def _hot(df: DataFrame) -> dict[str, int]:
    """Keys with a thousandth of the rows or more, of which there are a thousand at most."""
    return {"hot_rows": max(1000, df.count() // HOT_SHARE), "max_hot": HOT_SHARE}


def text_key(raw: Column) -> list[Column]:
    sha = F.sha2(raw, 256)
    half = lambda i: (F.conv(F.substring(sha, i, 8), 16, 10).cast("long") * F.lit(1 << 31) + F.conv(F.substring(sha, i + 8, 8), 16, 10).cast("long") / 2).cast("long")
    return [half(1).alias("k1"), half(17).alias("k2")]


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, token: int = TOKEN, group: int = GROUP, at_once: int = STEP_STRETCHES) -> DataFrame:
    """Per different text that holds repeats: k1, k2 (``text_key``), spans (byte ranges a to b that go) and kept (the bytes that stay)."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(raw.alias("raw")).filter(F.length("raw") >= length).select(*text_key(F.col("raw")), "raw")
    texts = texts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw")).select(*KEY, (F.col("n") > 1).alias("copied"), "raw")
    name = f"suffix_texts_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *KEY).saveAsTable(name)
    texts = spark.table(name)

    found = texts.mapInArrow(frugal(_sampled(length, token)), "k1 long, k2 long, copied boolean, token long, c1 long, c2 long, at long, again long")
    found = cut(found, "suffix-stretches")
    times = F.expr("cast(again & 4294967295 as long)") * F.when(F.col("copied"), 2).otherwise(1)
    often = found.groupBy("token").agg(F.sum(times).alias("n")).filter("n > 1").select("token")
    found = cut(found.join(often, "token"), "suffix-anchored")
    kinds = found.groupBy(*KIND).agg(F.sum(times).alias("n"), F.min(F.struct(*KEY, "at")).alias("one"))
    kinds = cut(kinds.select(*KIND, "n", "one.*"), "suffix-kinds")
    several = kinds.groupBy("token").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    width = F.expr("(at & 1048575) >> 10")
    settled = kinds.filter("n > 1").select(*KIND, F.array(F.struct(F.lit(0).alias("a"), width.cast("int").alias("b"))).alias("ranges"))

    place = F.expr("cast((at >> 20) + 1 as int)")
    content = F.substring(F.col("raw"), place, (width + length - 1).cast("int"))
    others = kinds.join(several, "token").join(texts.select(*KEY, "raw"), KEY)
    others = cut(others.select(*KIND, "n", "kinds", "at", content.alias("content")), "suffix-contents")
    near = others.filter(F.col("kinds") <= group).repartitionByRange("token").sortWithinPartitions("token")
    near = near.select(*KIND, "at", "content").mapInArrow(frugal(_sorted_bucket(length, at_once)), RANGES)
    far = others.filter(F.col("kinds") > group).select(*KIND, "at", "content").mapInArrow(frugal(_leads(length)), "token long, c1 long, c2 long, f1 long, f2 long, place int")
    far = cut(far, "suffix-leads")
    twice = far.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f1", "f2")
    far = hot_split_join(far, twice, ["f1", "f2"], **_hot(far)).groupBy(*KIND)
    far = far.agg(F.collect_list(F.struct(F.col("place").alias("a"), (F.col("place") + 1).cast("int").alias("b"))).alias("ranges"))
    compared = near.unionByName(far).filter(F.size("ranges") > 0)
    compared = compared.join(kinds.filter("n = 1").select(*KIND), KIND, "left_semi")
    ranges = cut(settled.unionByName(compared), "suffix-ranges")

    single = found.filter(~F.col("copied"))
    marks = hot_split_join(single, ranges, KIND, **_hot(single))
    marks = marks.groupBy(*KEY).agg(F.collect_list(F.struct("at", "again", "ranges")).alias("marks"))
    partly = texts.filter(~F.col("copied")).select(*KEY, "raw").join(marks, KEY).mapInArrow(frugal(_spans(length)), "k1 long, k2 long, spans array<struct<a: int, b: int>>, kept binary")
    whole = texts.filter("copied").select(*KEY, F.array(F.struct(F.lit(0).alias("a"), F.length("raw").alias("b"))).alias("spans"), F.lit(b"").alias("kept"))
    out = cut(partly.unionByName(whole), "suffix-spans")
    spark.sql(f"DROP TABLE {name}")  # its files stay for running jobs, in the checkpoint folder
    return out


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = cut(docs.select("doc_id", F.length(raw).cast("long").alias("n_bytes"), *text_key(raw), F.sha2(raw, 256).alias("sha")), "suffix-rows")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    found = repeated_spans(docs).select(*KEY, removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept"))
    out = hot_split_join(rows, found, KEY, "left", **_hot(rows))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
