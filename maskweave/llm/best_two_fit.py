"""Best-two-fit packing of documents into sequences of at most ``CAPACITY`` tokens.

A document is its ids and an end id; only documents longer than a sequence are cut, into
full pieces with the remainder first.  There are at most ``CAPACITY`` different lengths, so
the packing is worked out on the counts of lengths, however many documents there are: a
bin is opened by the longest piece left and filled greedily; then its smallest piece is
taken out if two pieces that are left fit the larger gap more tightly.  The same bin is
repeated as often as the counts allow.  The driver holds counts and bins only, and the
number of different bins is bounded by the lengths, not by the documents.  Pieces of a
length are then numbered across the cluster, and a piece's number says which bin, at which
offset, it goes to.

Defined results: null texts count as empty and are one piece, the end id; repeated rows are
packed as often as they come; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import cut, frugal, steps
from maskweave.llm.encoding import STEP, encoder, vocabulary
from maskweave.operators.joins import two_level_rank

CAPACITY = 2048
END = 0
TOKENIZER = "byte_bpe_50k.json"


def pieces_of(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY, lean: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32.

    ``lean`` takes smaller steps, which leaves memory to the other stages of a job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary(tokenizer), True)
        for b in steps(batches, limit=STEP // 4 if lean else STEP):
            ids, before = words.encode(b.column("text"))
            rows = []
            for i in range(b.num_rows):
                own = np.append(ids[before[i] : before[i + 1]], np.uint32(end)).astype("<u4")
                first = (len(own) - 1) % capacity + 1
                cuts = [0, *range(first, len(own) + 1, capacity)]
                data = own.tobytes()
                rows += [(i, p, s, e - s, zlib.crc32(data[4 * s : 4 * e])) for p, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            which, piece, start, length, crc = (pa.array(c, pa.int64()) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(which), piece.cast(pa.int32()), start, length, crc], ["doc_id", "piece", "start", "length", "ids_crc32"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def bins_of(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in one bin, how many such bins) for the number of pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sizes = np.arange(capacity + 1)
    out = []
    while left.any():
        inside: list[int] = []
        gap = capacity
        have = left.copy()
        while gap:  # fill greedily
            fits = np.flatnonzero(have[: gap + 1])
            if not len(fits):
                break
            inside.append(int(fits[-1]))
            have[fits[-1]] -= 1
            gap -= int(fits[-1])
        if gap:
            smallest = inside[-1]
            room = gap + smallest
            below = np.maximum.accumulate(np.where(have > 0, sizes, 0))  # the longest piece left up to each length
            first = np.flatnonzero(have[: room + 1])
            second = below[np.minimum(room - first, first)]
            alone = (second == first) & (have[first] < 2)
            second[alone] = below[np.maximum(first[alone] - 1, 0)]
            both = np.where(second > 0, first + second, 0)
            if len(both) and both.max() > smallest:
                at = int(np.argmax(both))
                inside[-1:] = [int(first[at]), int(second[at])]
        lengths, uses = np.unique(inside, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= uses * times
        out.append((inside, times))
    return out


def slots_of(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, number of its first piece, first sequence, offset), sorted: who goes where."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for inside, times in bins:
        offset = 0
        for length in inside:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one row per length, capacity at most
    slots = slots_of(bins_of(counts, capacity))
    keys = (slots[:, 0] << 48) + slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, (length << 48) + number - 1, side="right") - 1
            found = [pa.array(slots[at, 2] + number - 1 - slots[at, 1]), pa.array(slots[at, 3])]
            names = [n for n in b.schema.names if n not in ("number", "order")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *found], [*names, "sequence_id", "offset"])

    numbered = two_level_rank(pieces.withColumn("order", F.struct("doc_id", "piece", "ids_crc32")), ["length"], "order", "number")
    numbered = numbered.select(*pieces.columns, "number")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return numbered.mapInArrow(frugal(run), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, **options) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(cut(pieces_of(docs, **options), "pack-pieces"), options.get("capacity", CAPACITY))
