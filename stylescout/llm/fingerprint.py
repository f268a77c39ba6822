"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes cuts the UTF-8 text wherever it has a given remainder modulo the block size, so that an
edit moves only the cuts near it. Each piece gives one character of the signature. Block sizes
are 3, 6, 12, ...; a text uses the smallest at which ``PIECES`` pieces are expected for its length (a larger one where a pattern
that repeats would cut over four times as often), twice and four times that size: ``size:signature:signature:signature``. Texts of like length so have sizes in common, and two fingerprints are
compared by edit distance at the block sizes that both have.

Defined cases: null and empty texts have the fingerprint ``3:::``, alike (1.0) to each other and unlike (0.0) any other; texts of any
length are hashed whole; equal texts have equal fingerprints; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BLOCK = 3
#: pieces expected at the least of a text's block sizes, and how many sizes there are
PIECES = 128
LEVELS = 3
WINDOW = 7
#: signatures that share no run of this many characters count as unlike
COMMON_RUN = 5
#: documents of a range, about, and the most ranges
RANGE_ROWS = 2000
MOST_RANGES = 4096
#: bytes hashed at a time
SPAN = 1 << 20
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the rolling hash cuts at the least block size, and at how many doublings of it each still cuts."""
    found: list[list[np.ndarray]] = [[], []]
    for start in range(0, len(data), SPAN):
        begin = max(0, start - WINDOW + 1)
        part = data[begin : start + SPAN].astype(np.uint32)
        rolled = np.zeros(len(part), np.uint32)
        for back in range(min(WINDOW, len(part))):
            rolled[back:] += part[: len(part) - back] * np.uint32(pow(0x01000193, back + 1, 1 << 32))
        rolled ^= rolled >> np.uint32(15)
        rolled = (rolled[start - begin :] * np.uint32(0x2C1B3C6D)) >> np.uint32(2)
        hit = np.flatnonzero(rolled % np.uint32(LEAST_BLOCK) == LEAST_BLOCK - 1)
        third = (rolled[hit].astype(np.int64) + 1) // LEAST_BLOCK  # the hash cuts at 3 * 2**k if 2**k divides this
        for to, values in zip(found, (hit + start, np.log2((third & -third).astype(float)).astype(np.int64)), strict=True):
            to.append(values)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _pieces(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each piece; ends are the last bytes of all pieces but the last."""
    starts = np.concatenate(([0], ends + 1))
    if starts[-1] == len(data):
        starts = starts[:-1]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # position within the piece enters each byte's term, so that the sum depends on the order
    pieces = np.zeros(len(starts), np.uint64)
    for first in range(0, len(data), SPAN):
        last = min(len(data), first + SPAN)
        i, j = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "left")
        own = starts[i:j]
        inside = np.maximum(own, first)
        place = np.arange(first, last, dtype=np.int64) - np.repeat(own, np.diff(np.append(inside, last)))
        term = (data[first:last].astype(np.uint64) + np.uint64(1)) * _ODD ^ (place.astype(np.uint64) * _MIX)
        term = (term ^ (term >> np.uint64(29))) * _MIX
        pieces[i:j] += np.add.reduceat(term, inside - first)
    return pieces


def fingerprint(raw: bytes) -> str:
    """The fingerprint of a text's bytes."""
    data = np.frombuffer(raw, np.uint8)
    places, levels = _cuts(data)
    k = 0
    while (LEAST_BLOCK << k) * PIECES < len(data) or np.count_nonzero(levels >= k) > 4 * PIECES:
        k += 1
    return ":".join([str(LEAST_BLOCK << k), *(_letters(_pieces(data, places[levels >= x])) for x in range(k, k + LEVELS))])


def _letters(pieces: np.ndarray) -> str:
    return _LETTERS[(pieces * _ODD) >> np.uint64(58)].tobytes().decode()


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 cells at a time."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        u = row & at.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(COMMON_RUN, len(a), len(b))
    if not run:
        return 0.0
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))  # 1 - insertions and deletions / both lengths


def likeness(x: str, y: str) -> float:
    """From 0 to 1: the best over the block sizes that both fingerprints have; 0 if they have none in common."""
    if x == y:
        return 1.0
    (bx, *xs), (by, *ys) = x.split(":"), y.split(":")
    if not xs[0] or not ys[0]:
        return 0.0
    shift = (int(bx) // LEAST_BLOCK).bit_length() - (int(by) // LEAST_BLOCK).bit_length()
    pairs = zip(xs, ys[shift:], strict=False) if shift >= 0 else zip(xs[-shift:], ys, strict=False)
    return max((_alike(a, b) for a, b in pairs), default=0.0)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with a column of fingerprints; a column of that name is replaced."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(v or b"") for v in column.cast(pa.large_binary()).to_pylist()], pa.string())

    return docs.withColumn(name, F.arrow_udf(run, "string")(F.col(text)))


def edited(text: str, following: str) -> str:
    """The last third replaced by the first as many code points, or all, of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _bounds(ids: DataFrame, rows: int) -> list[int]:
    """Values of doc_id that cut the rows in ranges of about ``rows``; MOST_RANGES at most."""
    n = ids.count()
    parts = min(MOST_RANGES, max(1, -(-n // rows)))
    if parts == 1:
        return []
    found = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    return sorted(set(found or []))


def compare_neighbours(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each row of ``docs`` with its text edited by, and its fingerprint compared with, the next row in falling doc_id.

    Rows are dealt to ranges of doc_id, whose number is bounded and whose rows stream through a task; the first row of each range is
    also sent to the range before (that of the table to the last), so that no range needs another. Equal ids are ordered by
    text; null ids come last. doc_id is an integer. Other columns are not read.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    bounds = _bounds(ids, range_rows)

    def range_of(doc_id: int | None) -> int:
        return len(bounds) + 1 if doc_id is None else len(bounds) - bisect_left(bounds, doc_id)

    ranged = F.arrow_udf(_mapper(range_of, pa.int32()), "int")(F.col("doc_id"))
    first = ids.withColumn("r", ranged).groupBy("r").agg(F.max("doc_id").alias("top")).orderBy("r").collect()  # a row for each range
    before = {row["top"]: first[k - 1]["r"] for k, row in enumerate(first)}

    def targets(doc_id: int | None) -> list[int]:
        """Twice the row's range, and for a range's first row twice the range before plus 1."""
        own = [2 * range_of(doc_id)]
        return [*own, 2 * before[doc_id] + 1] if doc_id in before else own

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sent = rows.withColumn("to", F.explode(F.arrow_udf(_mapper(targets, pa.list_(pa.int32())), "array<int>")(F.col("doc_id"))))
    sent = sent.select("doc_id", "text", F.shiftright("to", 1).alias("range"), (F.col("to") % 2 == 1).alias("guest"))
    ordered = sent.repartition("range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _mapper(f, kind: pa.DataType):
    def run(column: pa.Array) -> pa.Array:
        return pa.array([f(v) for v in column.to_pylist()], kind)

    return run


def _compare(batches):
    """Rows in order of range and falling doc_id: each is done when the next of its range arrives; guests only serve."""
    held = None
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for doc_id, text, where, guest in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "range", "guest")), strict=True):
            own = fingerprint(text.encode("utf-8", "surrogatepass"))
            if held and held[2] == where and not held[3]:
                was_id, was, _, _, print_ = held
                new = edited(was, text).encode("utf-8", "surrogatepass")
                changed = fingerprint(new)
                row = (was_id, len(was), hashlib.sha256(new).hexdigest(), print_, changed, likeness(print_, changed), likeness(print_, own))
                for col, value in zip(out, row, strict=True):
                    col.append(value)
            held = doc_id, text, where, guest, own
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        yield pa.RecordBatch.from_arrays(list(map(pa.array, out, kinds)), list(names))
