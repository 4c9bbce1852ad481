"""Runs of periodic words in whole texts, by block convolution at dyadic scales.

A run is a stretch of consecutive words with smallest period q and at least
``max(MIN_LENGTH, MIN_REPEATS * q)`` words that no neighbouring word extends.  The texts of
a step lie one after another as word numbers, with a number of its own between two texts,
which no run can hold.  For every scale B = 1, 2, 4, ... the words are cut into blocks of B.
A run of period q, B <= q < 2B, holds a whole block and the block's copy q words later, so
each block is compared with the window that follows it: the sum of squared differences of
word numbers at distance d is the block's squares + the window's squares - 2 x their
correlation, and the correlations of all blocks come from one number-theoretic transform
modulo the prime ``PRIME``.  Distances where the sum is zero are seeds.  A seed is extended to
both sides by binary search on running hashes; the stretch found is then compared word by
word, so neither the modulus nor the hashes decide anything by themselves.  Stretches whose
period is a multiple of a smaller one are left out.

A block whose rarest word does not come again at a distance between B and 2B - 1 has no zero
there and is not transformed.  Distances inside a longer known run of a dividing period give
nothing new and are left out before the extension.

Work is row-local: about log² of a text's length a word, no shuffle.  Memory is a
few arrays over a step of ``STEP_CHARS`` bytes of text (one text at least, so a very long text is
a step of its own) and ``POINTS`` values of a transform at a time.

Defined results: null, empty and blank texts have no words and no runs; a null doc_id stays;
equal texts give equal rows and repeated rows come as often as they are given; of equally
good runs the first, then the shortest period is the best; an empty table gives an empty
result; further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import frugal, mix64, steps

MIN_LENGTH = 6
MIN_REPEATS = 4
#: 15 * 2**27 + 1, with primitive root 31: transforms of up to 2**27 points.
PRIME = np.uint64(2013265921)
ROOT = 31
#: Values that a transform holds at once.
POINTS = 1 << 21
_ROOTS: dict[tuple[int, bool], np.ndarray] = {}


def _roots(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a primitive root of unity of order 2 * half."""
    if (half, inverse) not in _ROOTS:
        p = int(PRIME)
        root = pow(ROOT, (p - 1) // (2 * half), p)
        root = pow(root, -1, p) if inverse else root
        powers = np.ones(1, np.uint64)
        while len(powers) < half:  # doubling
            powers = np.concatenate([powers, powers * np.uint64(pow(root, len(powers), p)) % PRIME])
        _ROOTS[half, inverse] = powers
    return _ROOTS[half, inverse]


def transform(values: np.ndarray) -> np.ndarray:
    """The number-theoretic transform of every row; the results are in bit-reversed order."""
    rows, n = values.shape
    half = n // 2
    while half:
        parts = values.reshape(rows, -1, 2, half)
        a, b = parts[:, :, 0], parts[:, :, 1]
        high = (a + b) % PRIME
        low = (a + (PRIME - b)) % PRIME * _roots(half, False) % PRIME
        values = np.stack([high, low], axis=2).reshape(rows, n)
        half //= 2
    return values


def transform_back(values: np.ndarray) -> np.ndarray:
    rows, n = values.shape
    half = 1
    while half < n:
        parts = values.reshape(rows, -1, 2, half)
        a, b = parts[:, :, 0], parts[:, :, 1] * _roots(half, True) % PRIME
        values = np.stack([(a + b) % PRIME, (a + (PRIME - b)) % PRIME], axis=2).reshape(rows, n)
        half *= 2
    return values * np.uint64(pow(n, -1, int(PRIME))) % PRIME


def correlations(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per row the sums of block[j] * window[j + d] modulo PRIME for d below the block's length; a window has two lengths."""
    rows, size = blocks.shape
    turned = np.zeros((rows, 2 * size), np.uint64)
    turned[:, 0] = blocks[:, 0]
    turned[:, size + 1 :] = blocks[:, :0:-1]
    return transform_back(transform(turned) * transform(windows) % PRIME)[:, :size]


def zero_distances(words: np.ndarray, squares: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of the blocks of ``size`` words whose copy stands ``size`` to ``2 * size - 1`` words later.

    ``words`` goes on for three blocks after the last start; ``squares`` are its running squares.
    """
    found = []
    for at in range(0, len(starts), max(1, POINTS // (2 * size))):
        some = starts[at : at + max(1, POINTS // (2 * size))]
        block = words[some[:, None] + np.arange(size)]
        window = words[some[:, None] + size + np.arange(2 * size)]
        after = some[:, None] + size + np.arange(size)
        total = (squares[some + size] - squares[some])[:, None] + squares[after + size] - squares[after]
        zero = total % PRIME == 2 * correlations(block, window) % PRIME
        row, distance = np.nonzero(zero)
        found.append((some[row], distance + size))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


class Extender:
    """How far words agree with the words a distance later."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        base = np.full(self.n + 1, np.uint64(0x9E3779B97F4A7C15))
        base[0] = 1
        self.powers = np.cumprod(base)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix64(words.astype(np.uint64) + np.uint64(1)) * self.powers[:-1], out=self.sums[1:])

    def equal(self, at: np.ndarray, distance: np.ndarray, length: int) -> np.ndarray:
        s, later = self.sums, at + distance
        return (s[at + length] - s[at]) * self.powers[distance] == s[later + length] - s[later]

    def reach(self, at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the longest stretch around ``at`` whose words equal those ``distance`` later."""
        first, end = at.copy(), at.copy()
        step = 1 << max(self.n.bit_length() - 1, 0)
        while step:
            ok = np.flatnonzero(end + distance + step <= self.n)
            ok = ok[self.equal(end[ok], distance[ok], step)]
            end[ok] += step
            ok = np.flatnonzero(first >= step)
            ok = ok[self.equal(first[ok] - step, distance[ok], step)]
            first[ok] -= step
            step //= 2
        return first, end


def _exact(words: np.ndarray, seeds: np.ndarray, first: int, end: int, distance: int) -> set[tuple[int, int]]:
    """The stretches of the seeds by comparing words; they are one unless hashes were equal by chance."""
    if np.array_equal(words[first:end], words[first + distance : end + distance]):
        return {(first, end)}
    differ = np.concatenate([[-1], np.flatnonzero(words[:-distance] != words[distance:]), [len(words) - distance]])
    i = np.searchsorted(differ, seeds)
    return set(zip((differ[i - 1] + 1).tolist(), differ[i].tolist()))


def _smaller_period(words: np.ndarray, first: int, end: int, period: int) -> bool:
    """Whether a proper divisor of ``period`` is a period of the stretch, too."""
    rest, p = period, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            q = period // p
            if np.array_equal(words[first : end - q], words[first + q : end]):
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def runs_of(words: np.ndarray, longest: int, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period.

    ``words`` are numbers from 0, ``longest`` bounds a run's length.  ``min_repeats`` is 4 or more.
    """
    n = len(words)
    runs: list[tuple[int, int, int]] = []
    if n < min_length or longest < min_length:
        return np.zeros((0, 3), np.int64)
    words = words.astype(np.int64)
    top = int(words.max()) + 1
    largest = 1 << max((longest // min_repeats).bit_length() - 1, 0)
    padded = np.concatenate([words, top + np.arange(3 * largest)]).astype(np.uint64)  # nothing equals what is behind the end
    squares = np.zeros(len(padded) + 1, np.uint64)
    np.cumsum(padded * padded % PRIME, out=squares[1:])
    extender = Extender(words)
    often = np.bincount(words)[words]
    order = np.argsort(words, kind="stable")
    places = words[order] * n + order  # by word, then place
    ahead = np.full(n, n)  # how far the same word stands ahead
    same = words[order[1:]] == words[order[:-1]]
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    rare = np.arange(n)  # of every block, the place of its rarest word
    cover_end, cover_period = np.zeros(n, np.int64), np.ones(n, np.int64)
    size = 1
    while size * min_repeats <= longest:
        if size > 1:
            pairs = rare[: len(rare) // 2 * 2].reshape(-1, 2)
            rare = np.where(often[pairs[:, 0]] <= often[pairs[:, 1]], pairs[:, 0], pairs[:, 1])
        again = (ahead[rare] >= size) & (ahead[rare] < 2 * size)
        nearer = np.flatnonzero(ahead[rare] < size)  # does it come a further time, in the window?
        key = words[rare[nearer]] * n + rare[nearer]
        found = np.searchsorted(places, key + size)
        bound = np.minimum(key + 2 * size, (words[rare[nearer]] + 1) * n)
        again[nearer] = (found < n) & (places[np.minimum(found, n - 1)] < bound)
        starts = np.flatnonzero(again) * size
        at, distance = zero_distances(padded, squares, starts, size)
        new = ~((distance % cover_period[at] == 0) & (at + distance + size <= cover_end[at]))
        at, distance = at[new], distance[new]
        first, end = extender.reach(at, distance)
        enough = end - first + distance >= np.maximum(min_length, min_repeats * distance)
        seeds = np.column_stack([first, distance, end, at])[enough]
        seeds = seeds[np.lexsort(seeds.T[::-1])]
        new = np.ones(len(seeds), bool)
        new[1:] = (seeds[1:, :3] != seeds[:-1, :3]).any(axis=1)
        for same in np.split(seeds, np.flatnonzero(new)[1:]) if len(seeds) else []:
            d = int(same[0, 1])
            for begin, end_ in _exact(words, same[:, 3], int(same[0, 0]), int(same[0, 2]), d):
                stop = end_ + d
                if stop - begin < max(min_length, min_repeats * d) or _smaller_period(words, begin, stop, d):
                    continue
                runs.append((begin, stop - begin, d))
                longer = begin + np.flatnonzero(cover_end[begin:stop] < stop)
                cover_end[longer], cover_period[longer] = stop, d
        size *= 2
    return np.array(sorted(set(runs)), np.int64).reshape(-1, 3)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, number of words of each)."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    sizes = pc.list_value_length(parts).to_numpy().astype(np.int64)
    flat = parts.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # blanks at an edge leave an empty part
    kept = np.concatenate([[0], np.cumsum(full)])
    ends = np.cumsum(sizes)
    return flat.filter(pa.array(full)), kept[ends] - kept[ends - sizes]


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[list, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Per document: its id, n_words, runs (array of start, length, period, in order) and collapsed.

    ``collapsed`` is the kept words joined by one space: of every run, what follows its first
    period is dropped.  ``edit`` may give, for the ids and numbers of words of some texts that lie
    one after another, the place whose word stands at each place instead.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            every, counts = words_of(b.column("text"))
            if edit:
                every = every.take(pa.array(edit(b.column("id").to_pylist(), counts)))
            coded = every.dictionary_encode()
            texts = np.arange(len(counts))
            which = np.repeat(texts, counts)
            begins = np.cumsum(counts + 1) - counts - 1
            words = np.empty(len(every) + len(counts), np.int64)
            words[np.arange(len(every)) + which] = coded.indices.to_numpy()
            words[begins + counts] = len(coded.dictionary) + texts  # between two texts
            runs = runs_of(words, int(counts.max()))
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
            stays = np.delete(np.cumsum(edge[:-1]) == 0, begins + counts)
            ends = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum(counts)])]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), every.filter(pa.array(stays))), pa.scalar(" ", pa.large_string()))
            text = np.searchsorted(begins, runs[:, 0], side="right") - 1
            own = np.searchsorted(text, np.arange(len(counts) + 1))
            mine = pa.StructArray.from_arrays([pa.array(runs[:, 0] - begins[text]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(run_type.value_type))
            found = pa.ListArray.from_arrays(pa.array(own, pa.int32()), mine)
            columns = [b.column("id"), pa.array(counts), found, collapsed.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "runs", "collapsed"])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), schema)


def plant(ids: list, counts: np.ndarray) -> np.ndarray:
    """The contract's edit: a tenth of the documents get a periodic tail."""
    place = np.arange(int(counts.sum()))
    begins = np.cumsum(counts) - counts
    for begin, n, doc_id in zip(begins.tolist(), counts.tolist(), ids):
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None and n else 1
        if h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            place[begin + a : begin + n] = begin + a + np.arange(n - a) % p
    return place


def run_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: the runs of the planted texts and their digests."""
    found = collapse_runs(docs, edit=plant)
    # cross products of longs below 2**31 tell which exponent is greater
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.try_element_at("runs", F.lit(1)),
        lambda x, r: F.when(
            (r["length"] * x["period"] > x["length"] * r["period"])
            | ((r["length"] * x["period"] == x["length"] * r["period"]) & ((r["start"] < x["start"]) | ((r["start"] == x["start"]) & (r["period"] < x["period"])))),
            r,
        ).otherwise(x),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(digest, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
