"""Best-fit packing of token sequences with certified bin counts.

Each document is its token ids and a closing id 0; only documents longer than a sequence are cut, into full pieces and a
rest. Pieces are dealt at random to partitions of about ``partition_items`` pieces. Each partition packs best-fit decreasing and
computes a lower bound on its number of bins from dual feasible functions. It is certified if its count equals the bound: no
packing of its pieces has fewer bins. What is sealed is another matter, decided by two rules: a partition whose count is
within one bin and ``LARGEST_GAP`` of the bound before rounding seals all its bins but the emptiest and those with more than one in
``LOOSE`` of a sequence left, which others' pieces may fill; any other seals its full bins
only (at most ``SEALED_ROOM`` left). The pieces of the bins that are not sealed are exchanged: dealt anew among fewer
partitions, which pack again, until one partition holds them or their partitions get fewer by less than one in fifty.

Defined cases: a null or empty text is one piece of length 1 (the closing id); equal lengths are ordered by doc_id and
piece, then as dealt; repeated rows are packed as often as they occur, and rows of one doc_id (null included) are dealt apart; an empty
table gives no rows; other columns of documents are not read; pack() keeps all columns of its items, but one named as one it adds is replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import durable, quoted, with_fields

CAPACITY = 2048
CLOSING_ID = 0
PARTITION_ITEMS = 4000
LARGEST_GAP = 0.002
SEALED_ROOM = 8
#: one in so many of a sequence left makes a bin worth exchanging in any partition
LOOSE = 8


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            owner, cols = [], [[], [], [], []]
            for i, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                data = np.append(ids, CLOSING_ID).astype("<u4")
                for k, start in enumerate(range(0, len(data), capacity)):
                    part = data[start : start + capacity]
                    owner.append(i)
                    for col, value in zip(cols, (k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        col.append(value)
            doc_ids = batch.column(0).take(pa.array(owner, pa.int64()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def volume_bound(lengths: np.ndarray, capacity: int) -> float:
    """The best bound on the number of bins, before rounding up, from three families of dual feasible functions.

    The volume; items above ``capacity - cut`` rounded up to a bin and items below ``cut`` down to nothing, for each cut; and, for
    small k, rounding to multiples of 1/k.
    """
    if not len(lengths):
        return 0.0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    above, weight = np.cumsum(count[::-1])[::-1], np.concatenate(([0], np.cumsum(count * size)))
    cuts = np.arange(1, capacity // 2 + 1)  # items longer than capacity - cut; those from cut to capacity - cut
    large, middle = above[capacity - cuts + 1], weight[capacity - cuts + 1] - weight[cuts]
    best = max(weight[-1] / capacity, (large + middle / capacity).max())
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # k * capacity * u_k(size)
        best = max(best, (value * count).sum() / (k * capacity))
    return float(best)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return int(np.ceil(volume_bound(lengths, capacity) - 1e-9))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, given from long to short; the room left in each bin."""
    open_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    left: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = rest = room - n
        if rest:
            if not open_bins.get(rest):
                open_bins[rest] = []
                rooms |= 1 << rest
            open_bins[rest].append(b)
    return bins, offsets, left


ADDED = "sequence_id long, offset long, n_bins int, bins_bound int, bins_certified boolean"


def _pack_part(number: int, final: bool, capacity: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        lengths = rows["length"].to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        volume = volume_bound(lengths, capacity)
        bound = int(np.ceil(volume - 1e-9))
        room = np.array(left)
        keep = np.ones(len(left), bool)
        if not final:
            if len(left) - volume < min(1, LARGEST_GAP * len(left)):
                keep = room <= capacity // LOOSE
                keep[room.argmax()] = room.max() == 0
            else:
                keep = room <= SEALED_ROOM
        names = number << 52 | key[0].as_py() << 26 | bins
        n = len(bins)
        added = (pa.array(names, pa.int64(), mask=~keep[bins]), pa.array(offsets, pa.int64()), *(pa.array([v] * n, k) for v, k in ((len(left), pa.int32()), (bound, pa.int32()), (bound == len(left), pa.bool_()))))
        rows = rows.drop_columns(["part"])
        for name, values in zip([f.split()[0] for f in ADDED.split(", ")], added, strict=True):
            rows = rows.append_column(name, values)
        return rows

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, partition_items: int = PARTITION_ITEMS) -> DataFrame:
    """``items`` (doc_id, piece, length and any others) with sequence_id, offset, and the count, bound and certificate of their partition's last round."""
    added = [f.split()[0] for f in ADDED.split(", ")]
    names = quoted([c for c in items.columns if c not in added])
    pool = durable(items.select("doc_id", "piece", F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("row"), F.struct(*names).alias("item")))
    schema = with_fields(pool.schema, ADDED)
    sealed, number, stalled = None, 0, False
    parts = max(1, -(-pool.count() // partition_items))
    while True:
        final = parts == 1 or stalled
        # by a row's own number: rows of one id do not meet
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(parts)))
        done = dealt.groupBy("part").applyInArrow(_pack_part(number, final, capacity), schema)
        if not final:
            done = durable(done)
        out = done.filter("sequence_id is not null")
        sealed = out if sealed is None else sealed.unionByName(out)
        if final:
            break
        pool = durable(done.filter("sequence_id is null").drop(*added))
        fewer = max(1, -(-pool.count() // partition_items))
        number, stalled, parts = number + 1, fewer * 50 > parts * 49, fewer
    return sealed.select("item.*", *added)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity), capacity)
