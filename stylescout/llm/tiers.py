"""Hierarchical packing of token sequences for several context sizes, without padding.

Each document is its token ids and a closing id. It goes to the shortest tier (512, 1024, 2048 or 4096 tokens) whose windows hold it; a
longer one first gives off full windows of the longest tier. In each of the partitions that the pieces are dealt to, tiers are packed from
the longest on: best-fit decreasing lays a tier's own pieces, then the gaps of its windows take the longest pieces of shorter tiers
that fit. What gap is left is closed exactly by a few documents that carry their ids (one in ``FILLER_ONE_IN``) and may be cut anywhere;
all others stay whole. A partition seals windows in step groups: ``STEP_TOKENS`` tokens of one tier, so that all steps cost the same
number of tokens and have one shape; a tier's windows are dealt to its steps by falling attention work (sum of squared piece
lengths), each to the step with the least so far. Pieces of windows that fill no whole step are exchanged: dealt anew among fewer
partitions. The last round seals the rest; there the cuttable documents are laid end to end in windows of falling powers of two, which
need no padding either. Only if no cuttable document is left is a window padded.

Defined cases: a null or empty text is one piece of length 1 (the closing id); equal lengths are ordered by the pieces' own
numbers; repeated rows are packed as often as they occur, and rows of one doc_id (null included) are dealt apart; an empty table gives
no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import durable
from .packing import best_fit_decreasing

TIERS = (512, 1024, 2048, 4096)
CLOSING_ID = 2
PARTITION_ITEMS = 4000
#: one in so many documents carries its ids and may be cut; a partition but the last holds back up to one in RESERVE_ONE_IN tokens for its gaps
FILLER_ONE_IN = 5
RESERVE_ONE_IN = 16
STEP_TOKENS = 16 * 4096


def pieces(docs: DataFrame, tokenizer: str, longest: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each document's full windows and rest; ids (little-endian 32-bit) of the rests that may be cut."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            owner, cols = [], [[], [], [], [], []]
            fills = batch.column(2).to_pylist()
            for i, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                raw = np.append(ids, CLOSING_ID).astype("<u4").tobytes()
                for start in range(0, len(raw), 4 * longest):
                    part = raw[start : start + 4 * longest]
                    kept = part if fills[i] and len(part) < 4 * longest else None
                    owner.append(i)
                    for col, value in zip(cols, (start // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4, kept), strict=True):
                        col.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *map(pa.array, cols, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fills = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(FILLER_ONE_IN)) == 0
    return docs.select("doc_id", "text", fills.alias("fills")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


class Window:
    """A sequence in the making: (item, first token, tokens) of each piece, in order."""

    def __init__(self, size: int) -> None:
        self.size, self.room, self.parts = size, size, []

    def put(self, item: int, first: int, n: int) -> None:
        self.parts.append((item, first, n))
        self.room -= n

    @property
    def work(self) -> int:
        return sum(n * n for _, _, n in self.parts)


def pack_tiers(lengths: list[int], items: list[int], tiers: tuple[int, ...]) -> list[Window]:
    """Windows of all tiers that hold the items whole; gaps of longer windows are filled from shorter tiers."""
    unplaced: dict[int, list[int]] = {}
    for i in sorted(items, key=lambda i: -i):
        unplaced.setdefault(lengths[i], []).append(i)
    present = sum(1 << n for n in unplaced)  # bit n: a piece of n tokens is left

    def take(n: int) -> int:
        nonlocal present
        i = unplaced[n].pop()
        if not unplaced[n]:
            del unplaced[n]
            present ^= 1 << n
        return i

    out = []
    for tier, shorter in zip(tiers[::-1], [*tiers[-2::-1], 0], strict=True):
        own = [take(n) for n in sorted((n for n in unplaced if n > shorter), reverse=True) for _ in range(len(unplaced[n]))]
        if not own:
            continue
        bins, _, left = best_fit_decreasing(np.array([lengths[i] for i in own]), tier)
        windows = [Window(tier) for _ in left]
        for i, b in zip(own, bins.tolist(), strict=True):
            windows[b].put(i, 0, lengths[i])
        for w in sorted(windows, key=lambda w: w.room):
            while fit := present & (2 << w.room) - 1:
                n = fit.bit_length() - 1
                w.put(take(n), 0, n)
        out += windows
    return out


class Fillers:
    """Documents that may be cut: whole ones go where they fit best, one at a time is cut up."""

    def __init__(self, lengths: list[int], items: list[int]) -> None:
        self.whole: dict[int, list[int]] = {}
        for i in items:
            self.whole.setdefault(lengths[i], []).append(i)
        self.present = sum(1 << n for n in self.whole)
        self.total = sum(lengths[i] for i in items)
        self.cut = (0, 0, 0)  # item, first token, tokens left

    def _take(self, n: int) -> int:
        i = self.whole[n].pop()
        if not self.whole[n]:
            del self.whole[n]
            self.present ^= 1 << n
        return i

    def fill(self, w: Window, partly: bool = False) -> bool:
        """Closes the window's gap, or with ``partly`` as much of it as can be; else False, and nothing done, if there are not tokens enough."""
        if w.room > self.total and not partly:
            return False
        n = min(w.room, self.total)
        self.total -= n
        goal = w.room - n
        while w.room > goal:
            item, first, left = self.cut
            if fit := self.present & (2 << w.room) - 1:
                n = fit.bit_length() - 1
                w.put(self._take(n), 0, n)
            elif left:
                n = min(left, w.room)
                w.put(item, first, n)
                self.cut = item, first + n, left - n
            else:
                n = self.present.bit_length() - 1
                self.cut = self._take(n), 0, n
        return True

    def rest(self) -> list[tuple[int, int, int]]:
        """What is left, as (item, first token, tokens)."""
        return [(i, 0, n) for n, found in self.whole.items() for i in found] + [self.cut] * (self.cut[2] > 0)


def lay_end_to_end(parts: list[tuple[int, int, int]], longest: int) -> list[Window]:
    """Full windows of the longest size, then of the powers of two that make up the rest."""
    total, at, out = sum(n for _, _, n in parts), 0, []
    sizes = [longest] * (total // longest) + [1 << k for k in reversed(range(longest.bit_length())) if total % longest >> k & 1]
    for size in sizes:
        w = Window(size)
        while w.room:
            item, first, left = parts[at]
            n = min(left, w.room)
            w.put(item, first, n)
            parts[at] = item, first + n, left - n
            at += n == left
        out.append(w)
    return out


def step_groups(windows: list[Window], per_step: int) -> list[list[Window]]:
    """Windows of one size in groups of ``per_step``, the last of them perhaps fewer, with even attention work: largest first, to the least-loaded."""
    n = -(-len(windows) // per_step)
    heap, groups = [(0, k) for k in range(n)], [[] for _ in range(n)]
    held = [per_step] * (n - 1) + [len(windows) - per_step * (n - 1)] if n else []
    for w in sorted(windows, key=lambda w: -w.work):
        load, k = heapq.heappop(heap)
        groups[k].append(w)
        if len(groups[k]) < held[k]:
            heapq.heappush(heap, (load + w.work, k))
    return groups


def arrange(lengths: list[int], cuttable: list[bool], final: bool, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> tuple[list[list[Window]], list[tuple[int, int, int]]]:
    """The step groups of a partition's items that are sealed, and the parts that are not (none in the final round)."""
    longest, reserve, held = tiers[-1], [], 0
    most = max(sum(lengths) // RESERVE_ONE_IN, 2 * longest)
    for i, can in enumerate(cuttable):
        if can and (final or held < most):
            reserve.append(i)
            held += lengths[i]
    back = set(reserve)
    windows = pack_tiers(lengths, [i for i in range(len(lengths)) if i not in back], tiers)
    fillers = Fillers(lengths, reserve)
    by_size: dict[int, list[Window]] = {}
    open_windows: list[Window] = []
    for w in windows:
        by_size.setdefault(w.size, []).append(w)
    for size, found in by_size.items():
        found.sort(key=lambda w: w.room)
        whole = len(found) if final else len(found) // (step_tokens // size) * (step_tokens // size)
        open_windows += found[whole:]
        del found[whole:]
    full: dict[int, list[Window]] = {}
    for w in sorted((w for found in by_size.values() for w in found), key=lambda w: w.room):
        (full.setdefault(w.size, []) if fillers.fill(w) else open_windows).append(w)
    if final:  # windows that nothing is left to fill: as few as can be, padded
        short = [p for w in open_windows for p in w.parts]
        short.sort(key=lambda p: -p[2])
        bins, _, left = best_fit_decreasing(np.array([n for _, _, n in short], np.int64), longest)
        padded = [Window(longest) for _ in left]
        for part, b in zip(short, bins.tolist(), strict=True):
            padded[b].put(*part)
        for w in padded:
            fillers.fill(w, partly=True)
        for w in [*padded, *lay_end_to_end(fillers.rest(), longest)]:
            full.setdefault(w.size, []).append(w)
        return [g for size, found in full.items() for g in step_groups(found, max(1, step_tokens // size))], []
    groups, rest = [], [p for w in open_windows for p in w.parts] + fillers.rest()
    for size, found in full.items():
        per_step = step_tokens // size
        whole = len(found) // per_step * per_step
        groups += step_groups(found[:whole], per_step)
        rest += [p for w in found[whole:] for p in w.parts]
    return groups, rest


ADDED = "sequence_id long, offset long, tier int, step long"


def _pack_part(number: int, final: bool, tiers: tuple[int, ...], step_tokens: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("row", "ascending")]).drop_columns(["part"])
        lengths, starts, crcs = (rows[c].to_pylist() for c in ("length", "start", "ids_crc32"))
        ids = rows["ids"].combine_chunks()
        groups, rest = arrange(lengths, pa.compute.is_valid(ids).to_pylist(), final, tiers, step_tokens)
        base = number << 52 | key[0].as_py() << 26
        names = ("item", "first", "n", "sequence_id", "offset", "tier", "step")
        out: dict[str, list] = {c: [] for c in names}

        def add(*values) -> None:
            for c, v in zip(names, values, strict=True):
                out[c].append(v)

        count = 0
        for step, group in enumerate(groups):
            for w in group:
                at = 0
                for item, first, n in w.parts:
                    add(item, first, n, base | count, at, w.size, base | step)
                    at += n
                count += 1
        for item, first, n in rest:
            add(item, first, n, None, None, None, None)
        found = rows.take(pa.array(out["item"], pa.int64()))
        cut = [n < lengths[i] for i, n in zip(out["item"], out["n"], strict=True)]
        raw = [ids[i].as_py()[4 * a : 4 * (a + n)] if c or s is None and ids[i].is_valid else None for i, a, n, c, s in zip(out["item"], out["first"], out["n"], cut, out["sequence_id"], strict=True)]
        new = {
            "start": pa.array([starts[i] + a for i, a in zip(out["item"], out["first"], strict=True)], pa.int64()),
            "length": pa.array(out["n"], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(r) if c else crcs[i] for i, r, c in zip(out["item"], raw, cut, strict=True)], pa.int64()),
            "ids": pa.array([r if s is None else None for r, s in zip(raw, out["sequence_id"], strict=True)], pa.binary()),
        }
        for name, values in new.items():
            found = found.set_column(found.column_names.index(name), name, values)
        for name, kind in (("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step", pa.int64())):
            found = found.append_column(name, pa.array(out[name], kind))
        return found

    return run


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, partition_items: int = PARTITION_ITEMS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, with its sequence_id and offset, the sequence's tier (its size; a padded one has the
    longest) and its step group."""
    pool = durable(pieces(docs, tokenizer, tiers[-1]).withColumn("row", F.monotonically_increasing_id()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema) + ", " + ADDED
    sealed, number, stalled = None, 0, False
    parts = max(1, -(-pool.count() // partition_items))
    while True:
        final = parts == 1 or stalled
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("row", "start", F.lit(number)), F.lit(parts)))  # by a row's own number: rows of one id do not meet
        done = dealt.groupBy("part").applyInArrow(_pack_part(number, final, tiers, step_tokens), schema)
        if not final:
            done = durable(done)
        out = done.filter("sequence_id is not null").drop("row", "ids")
        sealed = out if sealed is None else sealed.unionByName(out)
        if final:
            return sealed
        pool = durable(done.filter("sequence_id is null").drop("sequence_id", "offset", "tier", "step"))
        fewer = max(1, -(-pool.count() // partition_items))
        number, stalled, parts = number + 1, fewer * 50 > parts * 49, fewer
