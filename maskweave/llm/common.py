"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.session import checkpoint_dir

#: Fixed value: the separators of every contract's words.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
#: Characters that one step of a batched operator holds as Python or numpy objects.
STEP_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor re-reads files that all executors share.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that a slice has about ``limit`` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        ends = [*(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        at = 0
        for end in ends:
            yield b.slice(at, end - at)
            at = end
        pa.default_memory_pool().release_unused()


def frugal(run: Callable) -> Callable:
    """``run`` (batches to batches), after whose end the worker gives its free memory back to the system.

    A worker stays for later tasks, and its executor's other workers need the memory meanwhile.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offsets), with null as the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc32_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def held_out(col: str = "doc_id") -> Column:
    """True for the fifth of the documents from which nothing is learned."""
    return F.pmod(crc32_of_id(col), F.lit(5)) == 0


#: By byte: is it a blank of the contract's words; its lower case (A-Z only).
IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), base)]), dtype=np.uint64)
        _POWERS[str(base)] = have
    return have[:n]


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words before each text) of texts that lie one after another.

    Words are runs without blanks, in lower case (A-Z).  A word's hash is a difference of
    running sums of byte value times power of an odd base, shifted back to its start.
    """
    blank = IS_BLANK[flat]
    edge = np.ones(len(flat) + 1, bool)
    edge[1:-1] = blank[:-1]
    edge[offsets] = True  # a text starts a word of its own
    starts = np.flatnonzero(edge[:-1] & ~blank)
    stop = np.ones(len(flat) + 1, bool)
    stop[:-1] = blank
    stop[offsets] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[LOWER_BYTE[flat]] * _powers(_BASE, len(flat)), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * _powers(_INVERSE, len(flat) + 1)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(hashes: np.ndarray, before: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each text; shingles before each text).

    A text with fewer than ``size`` words has one shingle, all its words; without words, none.
    """
    counts = np.diff(before)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - before[:-1][text] if len(counts) else np.zeros(0, np.int64)
    value = np.zeros(len(hashes), np.uint64)
    for j in range(size):  # words past a short text's end add nothing
        there = np.flatnonzero(place + j < counts[text])
        value[there] += mix64(hashes[there + j] + np.uint64(j + 1)) * _powers(_BASE, size + 1)[j]
    keep = (place == 0) | (place + size <= counts[text])
    value, text = mix64(value[keep]), text[keep]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(counts) + 1))
