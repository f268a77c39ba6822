"""Prefix trie of conversations: which first turns are shared, by whom, and what encoding them once would save.

A turn is a symbol of 20 bytes: MD5 of role and text, and the text's length. A conversation is a sequence of symbols, laid down in segments
of ``segment`` turns, so that no row grows with a conversation. Segments are sorted over all executors by what precedes them (level, hash
of the turns before) and their symbols. A node of the trie, a distinct sequence of first turns, is then an interval of rows. In each range of rows a
sparse table holds the least common prefix of neighbours over all windows of 2 ** k rows: a prefix, from the row where it first occurs, and its parent
find their left and right ends by bisecting it, each on its own. Numbers of an interval are differences of running sums, its smallest conversation is
a minimum from a second sparse table. Prefixes that go on in the next range give a part in each; these parts, a few for each range, are added up by key.

What lies below a segment is carried by the segment's own row: lengths that follow, and the new nodes and leaves first met further on in the
same conversation. So one pass finds the sums of whole subtrees, however deep.

Defined cases: rows without conv_id belong to no conversation and are left out; null roles and texts are empty; turns of one
number are ordered by their symbols; repeated rows are turns of their own; a conversation without turns is a member of the root only;
an empty table gives no rows, not even a root; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, stored

#: turns of a segment
SEGMENT = 32
SYMBOL = 20
#: segments in a range of the sorted rows, about
RANGE_ROWS = 30_000
#: turns of one conversation that are joined under one key
BLOCK_TURNS = 4096
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _ranges(df: DataFrame, keys: list, per_range: int, rows: int | None = None) -> DataFrame:
    """``df`` sorted over ranges of about ``per_range`` rows, materialised: partitions and their order stay."""
    rows = df.count() if rows is None else rows
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_range))
    return durable(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys))


def _whole(batches) -> pa.Table | None:
    """A range's rows as one table."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0, by turn with null first), symbol of every turn; no conversation is brought to one task."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    symbol = F.concat(F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text))), F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), symbol.alias("symbol"))
    keys = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("symbol").asc()]
    rows = _ranges(stored(turns), keys, 10 * RANGE_ROWS)

    def last(batches):
        t = _whole(b.select(["conv_id"]) for b in batches)
        if t is not None:
            ids = t.column(0).to_numpy()
            n = int((ids == ids[-1]).sum())
            yield pa.RecordBatch.from_pylist([{"range": TaskContext.get().partitionId(), "first": ids[0], "last": ids[-1], "n": n}])

    # a row for each range
    before: dict[int, int] = {}
    open_id, open_n = None, 0
    for r in sorted(rows.mapInArrow(last, "range long, first long, last long, n long").collect()):
        if r["first"] == open_id:
            before[r["range"]] = open_n
        open_n = r["n"] + (open_n if r["last"] == open_id else 0)
        open_id = r["last"]

    def number(batches):
        held, n = None, before.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            ids = b.column("conv_id").to_numpy()
            if not len(ids):
                continue
            first = np.flatnonzero(np.diff(ids, prepend=ids[0] if held in (None, ids[0]) else ids[0] - 1))
            start = np.zeros(len(ids), np.int64)
            start[first] = first
            place = np.arange(len(ids)) - np.maximum.accumulate(start)
            same = len(ids) if not len(first) else first[0]
            place[:same] += n
            held, n = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(place, pa.int64()), b.column("symbol")], ["conv_id", "place", "symbol"])

    return rows.mapInArrow(number, "conv_id long, place long, symbol binary")


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt on shared heads: the first h turns of conversation c - c % every, then c's own behind its first h, with h = crc32(c) % most.

    conv_id, place, symbol; a conversation left without turns is one row with a null symbol.
    """
    turns = stored(turns)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("place") < most - 1)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]).alias("head"))  # most - 1 turns at most
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n_own")).select("conv_id", "n_own", h.alias("h"), base.alias("base"))
    head = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h").cast("int"))
    convs = stored(convs.join(heads, "base", "left").select("conv_id", "n_own", "h", head.alias("head")))
    empty = (F.col("n_own") <= F.col("h")) | F.col("symbol").isNotNull()  # a null stands for no turns; own turns need none
    first = convs.select("conv_id", "n_own", "h", F.posexplode_outer("head").alias("place", "symbol")).filter(empty)
    first = first.select("conv_id", F.coalesce(F.col("place"), F.lit(0)).cast("long").alias("place"), "symbol")
    blocks = convs.filter("n_own > h").select("conv_id", (F.size("head") - F.col("h")).alias("shift"), F.explode(F.expr(f"sequence(0, (n_own - 1) div {BLOCK_TURNS})")).alias("block"))
    own = turns.filter(F.col("place") >= h).withColumn("block", F.expr(f"place div {BLOCK_TURNS}")).join(blocks, ["conv_id", "block"])
    return first.unionByName(own.select("conv_id", (F.col("place") + F.col("shift")).alias("place"), "symbol"))


def segments(turns: DataFrame, segment: int) -> DataFrame:
    """conv_id, level (segment number), symbols (one after another) and ``ends`` (no segment follows), with what is carried for the levels around."""
    grouped = turns.groupBy("conv_id", F.expr(f"place div {segment}").alias("level")).agg(
        F.array_sort(F.collect_list(F.when(F.col("symbol").isNotNull(), F.struct("place", "symbol")))).alias("turns")  # as many as a segment has at most
    )
    joined = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["symbol"])), ""))
    rows = stored(grouped.select("conv_id", "level", joined.alias("symbols"), F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + _length(x["symbol"])).alias("size")))
    deep = rows.filter("level > 0").select("conv_id").distinct()
    zero = F.lit(0).cast("long")
    short = rows.join(deep, "conv_id", "left_anti").select(
        "conv_id", "level", "symbols", F.lit(True).alias("ends"), *(zero.alias(c) for c in ("before_a", "before_b", *_CARRIED)), F.lit(None).cast("long").alias("above")
    )
    if deep.isEmpty():
        return short
    full = short.filter(F.length("symbols") == segment * SYMBOL).select("conv_id", "level", *(h.alias(f"until_{s}") for s, h in _hashes().items()))
    return short.unionByName(_deep(rows.join(deep, "conv_id", "left_semi"), full, segment))


def _length(symbol) -> "F.Column":
    return F.conv(F.hex(F.substring(symbol, SYMBOL - 3, 4)), 16, 10).cast("long")


_CARRIED = ("after", "nodes_below", "leaves_below", "children_below")


def _keys() -> list:
    """What segments are sorted by: those that end come before those that go on."""
    return ["level", "before_a", "before_b", "symbols", F.col("ends").desc(), "conv_id"]


def _hashes() -> dict:
    """Two hashes of a segment and its level; those of several are joined by exclusive or."""
    return {s: F.xxhash64(F.lit(s), "level", "symbols") for s in "ab"}


def _deep(rows: DataFrame, full: DataFrame, segment: int) -> DataFrame:
    """The segments of conversations that have more than one, with hashes of what precedes, and sums of what follows.

    ``full``: conv_id, level and hashes of the full segments of all other conversations.
    """
    ordered = Window.partitionBy("conv_id").orderBy("level")  # a row for a segment's turns
    earlier, later = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.select(
        "conv_id", "level", "symbols", F.lead("level").over(ordered).isNull().alias("ends"),
        *(F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(f"before_{s}") for s, x in _hashes().items()),
        *(F.bit_xor(x).over(ordered).alias(f"until_{s}") for s, x in _hashes().items()),
        F.coalesce(F.sum("size").over(later), F.lit(0)).alias("after"),
    )
    rows = stored(rows)
    own = ["conv_id", "level", "symbols", "ends", "before_a", "before_b", "after"]
    # what each segment of the deeper levels is the first to bring: new nodes' lengths, a leaf, a child of the node above
    lower = _ranges(rows.filter("level > 0").select(*own), _keys(), RANGE_ROWS)
    edges = _edges(lower)

    def marks(batches):
        t = _whole(batches)
        if t is not None:
            x = Range(t, *edges[TaskContext.get().partitionId()])
            child = (x.actual <= 0) & (x.n_turns > 0)
            yield from t.append_column("new", pa.array(x.new)).append_column("leaf", pa.array(x.leaf)).append_column("child", pa.array(child.astype(np.int64))).to_batches()

    schema = "conv_id long, level long, symbols binary, ends boolean, before_a long, before_b long, after long, new long, leaf long, child long"
    zero = F.lit(0).cast("long")
    rows_all = lower.mapInArrow(marks, schema).unionByName(rows.filter("level = 0").select(*own, *(zero.alias(c) for c in ("new", "leaf", "child"))))
    summed = rows_all.select(
        *own,
        F.coalesce(F.sum("new").over(later), F.lit(0)).alias("nodes_below"),
        F.coalesce(F.sum("leaf").over(later), F.lit(0)).alias("leaves_below"),
        F.coalesce(F.lead("child").over(ordered), F.lit(0)).alias("children_below"),
    )
    full = full.unionByName(rows.filter(F.length("symbols") == segment * SYMBOL).select(*full.columns))
    above = full.groupBy((F.col("level") + 1).alias("level"), F.col("until_a").alias("before_a"), F.col("until_b").alias("before_b"))
    return summed.join(above.agg(F.min("conv_id").alias("above")), ["level", "before_a", "before_b"], "left")


def _common(x: bytes, y: bytes) -> int:
    """Whole symbols that two segments start with."""
    n = 0
    while n < min(len(x), len(y)) and x[n : n + SYMBOL] == y[n : n + SYMBOL]:
        n += SYMBOL
    return n // SYMBOL


def _edges(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range: common turns of its first row with the one before it, and of its last with the one behind it; -1 where they are of different groups."""

    def ends(batches):
        first = last = None
        for b in batches:
            if b.num_rows:
                first = first or b.slice(0, 1).to_pylist()[0]
                last = b.slice(b.num_rows - 1, 1).to_pylist()[0]
        if first:
            yield pa.RecordBatch.from_pylist([{"range": TaskContext.get().partitionId(), **{f"{c}{i}": r[c] for i, r in enumerate((first, last)) for c in _EDGE}}])

    kinds = ("long", "long", "long", "binary")
    schema = ", ".join(["range long", *(f"{c}{i} {k}" for i in (0, 1) for c, k in zip(_EDGE, kinds, strict=True))])
    found = sorted((r.asDict() for r in rows.select(*_EDGE).mapInArrow(ends, schema).collect()), key=lambda r: r["range"])  # two rows for each range
    out = {r["range"]: [-1, -1] for r in found}
    for x, y in pairwise(found):
        if all(x[f"{c}1"] == y[f"{c}0"] for c in _EDGE[:3]):
            out[x["range"]][1] = out[y["range"]][0] = _common(x["symbols1"], y["symbols0"])
    return {k: tuple(v) for k, v in out.items()}


_EDGE = ["level", "before_a", "before_b", "symbols"]


class SparseTable:
    """Least values over all windows of 2 ** k entries."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            w, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(w[:-half], w[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of entries first to last, both included."""
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for j, w in enumerate(self.levels):
            at = k == j
            out[at] = np.minimum(w[first[at]], w[last[at] - 2**j + 1])
        return out

    def left(self, row: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least l such that entries l + 1 to row are all >= bound."""
        row = row.copy()
        for j in reversed(range(len(self.levels))):
            to = row - 2**j
            ok = np.flatnonzero(to >= 0)
            ok = ok[self.levels[j][to[ok] + 1] >= bound[ok]]
            row[ok] = to[ok]
        return row

    def right(self, row: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest r such that entries row + 1 to r are all >= bound."""
        row, n = row.copy(), len(self.levels[0])
        for j in reversed(range(len(self.levels))):
            to = row + 2**j
            ok = np.flatnonzero(to < n)
            ok = ok[self.levels[j][row[ok] + 1] >= bound[ok]]
            row[ok] = to[ok]
        return row


class Range:
    """A range of sorted segments: common prefixes of neighbours, and what each row is the first to bring."""

    def __init__(self, rows: pa.Table, before: int, behind: int) -> None:
        raw = rows.column("symbols").to_pylist()
        n = len(raw)
        self.raw, self.before, self.behind = raw, before, behind
        self.n_turns = np.array([len(x) // SYMBOL for x in raw], np.int64)
        self.level, a, b = (rows.column(c).to_numpy() for c in ("level", "before_a", "before_b"))
        self.ends = rows.column("ends").to_numpy(zero_copy_only=False).astype(bool)
        flat = np.frombuffer(b"".join(raw), np.dtype([("hash", "V16"), ("length", ">u4")]))
        number = np.unique(np.frombuffer(flat.tobytes(), f"V{SYMBOL}"), return_inverse=True)[1]
        width = int(self.n_turns.max()) if n else 0
        filled = np.arange(width) < self.n_turns[:, None]
        turns = np.full((n, width), -1, np.int64)
        turns[filled] = number
        #: length of a row's first 0, 1, 2... texts
        self.prefix = np.zeros((n, width + 1), np.int64)
        self.prefix[:, 1:][filled] = flat["length"]
        self.prefix = np.cumsum(self.prefix, 1)
        self.size = self.prefix[:, -1]
        #: common turns with the row before; -1 for another group, and for a range's first row
        self.common = np.full(n, -1, np.int64)
        same = (turns[1:] == turns[:-1]) & filled[1:]
        group = (self.level[1:] == self.level[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        self.common[1:] = np.where(group, np.cumprod(same, 1).sum(1), -1)
        #: the rows of the first one's group
        self.with_first = (self.level == self.level[0]) & (a == a[0]) & (b == b[0])
        #: the same, with the rows of the ranges around
        self.actual = self.common.copy()
        self.actual[:1] = before
        self.new = self.size - self.prefix[np.arange(n), np.maximum(self.actual, 0)]
        self.leaf = (self.ends & (np.append(self.actual[1:], behind) < self.n_turns)).astype(np.int64)


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PART = _NODE + ", range long, key binary, parent_key binary, ids string"


def _nodes(rows: pa.Table, segment: int, number: int, before: int, behind: int) -> pa.RecordBatch:
    """The nodes of a range. One that goes on beyond it has a key, and the ids of its ends in place of their digest."""
    x = Range(rows, before, behind)
    n = len(x.raw)
    conv = rows.column("conv_id").to_numpy()
    above = rows.column("above").to_numpy(zero_copy_only=False)
    after, nodes_below, leaves_below, children_below = (rows.column(c).to_numpy() for c in _CARRIED)
    least_common, least_conv = SparseTable(x.common), SparseTable(conv)
    # candidates: a prefix of t turns at the row where it first occurs; the root (t = 0) is a node of level 0 only
    low = np.maximum(x.common + 1, (x.level > 0).astype(np.int64))
    many = np.maximum(x.n_turns - low + 1, 0)
    row = np.repeat(np.arange(n), many)
    t = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
    first, last = least_common.left(row, t), least_common.right(row, t)
    open_left = (first == 0) & (t <= before)
    open_ = open_left | ((last == n - 1) & (t <= behind))
    total = lambda v: np.concatenate(([0], np.cumsum(v)))
    between = lambda sums, i, j: sums[j + 1] - sums[i]
    up = x.prefix[first, np.maximum(t - 1, 0)]  # length of the turns above the node
    at_first = np.where(open_left, x.new[first], x.size[first] - up)
    new = total(x.new)
    distinct = at_first + between(new, first + 1, last) + between(total(nodes_below), first, last)
    n_convs = last - first + 1
    saved = between(total(x.size + after), first, last) - n_convs * up - distinct
    leaves = between(total(x.leaf + leaves_below), first, last)
    # children: rows that branch off at t turns, and the first row where it goes on
    branch = np.flatnonzero((x.common >= 0) & (x.n_turns > x.common))
    keys = np.sort(x.common[branch] * n + branch)
    children = np.searchsorted(keys, t * n + last, "right") - np.searchsorted(keys, t * n + first, "right")
    children += np.where(open_left, (x.actual[first] == t) & (x.n_turns[first] > t), x.n_turns[first] > t)
    children += np.where(t == segment, between(total(children_below), first, last), 0)
    # parents: the same row's prefix of one turn less; above a segment's first turn, what its row carries
    carried = (x.level[row] > 0) & (t == 1)
    rooted = (x.level[row] == 0) & (t == 0)
    p_first, p_last = least_common.left(row, t - 1), least_common.right(row, t - 1)
    p_open = (((p_first == 0) & (t - 1 <= before)) | ((p_last == n - 1) & (t - 1 <= behind))) & ~carried & ~rooted
    parent = np.where(rooted, 0, least_conv.least(p_first, p_last))
    parent[carried] = above[row[carried]].astype(np.int64)

    known: dict[tuple[bool, int], bytes] = {}

    def key(i: int, turns: int) -> bytes:
        """An open prefix is one of the range's first or last row."""
        at_end = not (turns <= before and x.with_first[i] and x.raw[0][: turns * SYMBOL] == x.raw[i][: turns * SYMBOL])
        if (at_end, turns) not in known:
            r = n - 1 if at_end else 0
            group = [str(rows.column(c)[r].as_py()) for c in _EDGE[:3]]
            known[at_end, turns] = hashlib.md5(",".join([*group, str(turns), ""]).encode() + x.raw[r][: turns * SYMBOL]).digest()
        return known[at_end, turns]

    # rows that end at the node are the first of its interval
    stop = np.flatnonzero(~((x.common == x.n_turns) & x.ends))
    stop = np.append(stop, n)
    ends_here = (x.n_turns[first] == t) & x.ends[first]
    behind_ends = np.minimum(stop[np.searchsorted(stop, first, "right")], last + 1)
    names = list(map(str, conv.tolist()))
    sha, ids, node_keys, parent_keys = [], [], [], []
    columns = (f.tolist() for f in (row, t, first, behind_ends, ends_here, open_, p_open))
    for i, d, f, stop_at, has, is_open, p_is_open in zip(*columns, strict=True):
        said = ",".join(names[f:stop_at]) if has else ""
        sha.append(None if is_open else hashlib.sha256(said.encode()).hexdigest() if said else _EMPTY_SHA)
        ids.append(said if is_open else None)
        node_keys.append(key(i, d) if is_open else None)
        parent_keys.append(key(i, d - 1) if p_is_open else None)
    made = [
        pa.array(least_conv.least(first, last)), pa.array(x.level[row] * segment + t), pa.array(parent, mask=rooted | p_open), pa.array(n_convs), pa.array(children), pa.array(leaves),
        pa.array(saved), pa.array(sha, pa.string()), pa.array(np.full(len(row), number), pa.int64()), pa.array(node_keys, pa.binary()), pa.array(parent_keys, pa.binary()), pa.array(ids, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(made, [c.split()[0] for c in _PART.split(", ")])


def _add_parts(batches):
    """One row for each key of rows sorted by key and range."""
    held: dict | None = None
    digest, some = hashlib.sha256(), False

    def done():
        held["ends_sha256"] = digest.hexdigest()
        return pa.RecordBatch.from_pylist([held], pa.schema(_MERGED))

    for b in batches:
        for r in b.to_pylist():
            ids = r.pop("ids")
            if held is None or held["key"] != r["key"]:
                if held is not None:
                    yield done()
                held, digest, some = r, hashlib.sha256(), False
            else:
                held["conv_id"] = min(held["conv_id"], r["conv_id"])
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    held[c] += r[c]
            if ids:
                digest.update(f",{ids}".encode() if some else ids.encode())
                some = True
    if held is not None:
        yield done()


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_MERGED = [(c, _KINDS[k]) for c, k in (f.split() for f in _PART.split(", ")) if c != "ids"]


def prefix_trie(turns: DataFrame, range_rows: int = RANGE_ROWS, segment: int = SEGMENT) -> DataFrame:
    """Every node of the trie of conversations (conv_id, place, symbol; a null symbol for one without turns).

    conv_id: smallest member; depth; parent_conv_id; n_convs: members; n_children; n_leaves: childless nodes in its subtree; saved_tokens: over
    its subtree, each node's (n_convs - 1) times its last text's length; ends_sha256: digest of the members that end here.
    """
    rows = _ranges(stored(segments(turns, segment)), _keys(), range_rows)
    edges = _edges(rows)

    def find(batches):
        t = _whole(batches)
        if t is not None:
            number = TaskContext.get().partitionId()
            yield _nodes(t, segment, number, *edges[number])

    found = stored(rows.mapInArrow(find, _PART))
    names = [c.split()[0] for c in _NODE.split(", ")]
    parts = found.filter("key is not null")
    merged = durable(parts.repartition("key").sortWithinPartitions("key", "range").mapInArrow(_add_parts, ", ".join(f for f in _PART.split(", ") if not f.startswith("ids "))))
    # a range's own copy of each open node it takes part in: no key of the join is held by more than one range
    lookup = parts.select("range", "key").join(merged.select("key", F.col("conv_id").alias("found")), "key").withColumnRenamed("key", "parent_key")
    closed = found.filter("key is null").select(*names, "range", "parent_key")
    whole = closed.filter("parent_key is null").select(*names).unionByName(merged.filter("parent_key is null").select(*names))
    asking = closed.filter("parent_key is not null").unionByName(merged.filter("parent_key is not null").select(*names, "range", "parent_key"))
    answered = asking.join(lookup, ["range", "parent_key"]).withColumn("parent_conv_id", F.col("found")).select(*names)
    return whole.unionByName(answered)
