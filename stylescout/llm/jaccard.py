"""N-gram Jaccard join by vertical partitioning.

1. Every document becomes its set of word n-gram hashes (64 bits, the one approximation: two different n-grams with one hash
   are taken as equal). Documents with equal sets form a class, by two independent sums over the set that make 128 bits, and its size;
   all later work is on classes.
2. To find the shared n-grams, the hashes are dealt by ranges. Each task sends, for each range, the sorted hashes of its documents'
   sets as one packed array, a class once (up to ``SEEN_CLASSES`` classes are remembered, so that copies cost nothing). A range
   counts in how many classes each of its n-grams occurs. N-grams of one class only cannot overlap.
3. The global n-gram order is rising class count, then hash. It is cut into ``FRAGMENTS`` fragments, and each class's shared n-grams
   are kept as a segment for each fragment. A class whose shared n-grams are too few for any partner is done.
   The others enter their prefixes (those n-grams of which a partner must have one, in that order) in posting lists.
4. Each list first compares all its classes with its most typical one only: a number of pairs linear in the lists. Pairs whose sizes,
   or whose shared n-grams from the posting on, rule a link out are left out throughout. Overlaps are counted in
   each fragment of the order separately and summed for each pair; pairs at or above the threshold link. Then every list in which
   classes of different components remain compares those outside its largest component with all others that are not yet
   compared. So lists of near copies never yield all their pairs, and no link between components is lost.

Defined cases: null or wordless texts have no n-grams and link with nothing; fewer than n words are one n-gram, the
whole sequence; repeated rows are copies; rows with a null doc_id count as documents, and a component's id is the least id of any of its rows
(null if none has one); rows of one doc_id with different texts are different documents; only A to Z are lower-cased; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import CHEAP_WORDS, Memo, compact, counted, few, quoted, stored, text_blocks, with_fields

N = 5
PERCENT = 80
#: n-grams a range of hashes holds, about; and the least number of ranges
RANGE_NGRAMS = 8_000_000
LEAST_RANGES = 64
#: bytes of packed hashes above which a range is worked through in parts
SUBRANGE_BYTES = 16_000_000
#: class counts at which the global order is cut; n-grams of the least count are cut in PAIR_FRAGMENTS ranges of hashes besides
COUNT_CUTS = (3, 4, 8, 32)
PAIR_FRAGMENTS = 4
FRAGMENTS = PAIR_FRAGMENTS + len(COUNT_CUTS)
#: classes a task remembers as sent
SEEN_CLASSES = 200_000
#: rounds of comparisons with one class of a list, after the first
STAR_ROUNDS = 2
#: bytes of text that go into one set of packed segments
RUN_BYTES = 8_000_000
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


class NGrams:
    """Distinct n-gram hashes of texts given as UTF-8."""

    def __init__(self, n: int) -> None:
        self.n, self.memo, self.hashes = n, Memo(), np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes | None]):
        import xxhash

        if len(self.memo) > CHEAP_WORDS:
            self.memo, self.hashes = Memo(), np.zeros(0, np.uint64)
        held = []
        for t in texts:
            words = t.lower().split() if t else []  # of bytes: A to Z only, and white space of ASCII
            held.append(np.fromiter(map(self.memo.__getitem__, words), np.int32, len(words)))
        new = [xxhash.xxh64_intdigest(w) for w in self.memo.take()]
        self.hashes = np.concatenate((self.hashes, np.array(new, np.uint64)))
        for numbers in held:
            yield self._set(self.hashes[numbers])

    def _set(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        n = min(self.n, len(words))
        grams = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            grams = mix(grams + _K1) + words[k : len(words) - n + 1 + k]
        return np.unique(mix(grams))


CLASS = np.dtype("V16")
_SEEDS = np.array([_K1, _K3])


def _class_of(grams: np.ndarray) -> bytes:
    """128 bits for a set: equal sets have equal ones."""
    with np.errstate(over="ignore"):
        sums = np.array([mix(grams + seed).sum(dtype=np.uint64) for seed in _SEEDS]) + np.uint64(len(grams)) * _K2
        return mix(sums).tobytes()


def _texts(column: pa.Array, limit: int):
    """(first row, texts as UTF-8) of slices of about ``limit`` bytes."""
    return text_blocks(column.cast(pa.large_binary()), limit)


def signatures(docs: DataFrame, n: int = N, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles and class of every row, and the columns in ``keep``; class is null where there are no n-grams."""

    def run(batches):
        made = NGrams(n)
        for batch in batches:
            sizes, classes = [], []
            for _, texts in _texts(batch.column(1), RUN_BYTES):
                for grams in made.sets(texts):
                    sizes.append(len(grams))
                    classes.append(_class_of(grams) if len(grams) else None)
            rest = [batch.column(2 + i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), *rest], ["doc_id", "n_shingles", "class", *keep])

    found = with_fields(docs.select("doc_id").schema, "n_shingles long, class binary")
    return docs.select("doc_id", "text", *keep).mapInArrow(run, StructType([*found.fields, *(docs.schema[c] for c in keep)]))


def _planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _values(data: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def segments(docs: DataFrame, ranges: int, n: int = N) -> DataFrame:
    """range, hashes, owners, classes: packed parts of the documents' sets, each class once for a task as far as it remembers."""

    def run(batches):
        made, seen = NGrams(n), set()
        for batch in batches:
            for _, texts in _texts(batch.column(1), RUN_BYTES):
                sets: dict[bytes, np.ndarray] = {}
                for grams in made.sets(texts):
                    if len(grams) and (key := _class_of(grams)) not in seen:
                        sets.setdefault(key, grams)
                if not sets:
                    continue
                if len(seen) + len(sets) > SEEN_CLASSES:
                    seen.clear()
                seen.update(itertools.islice(sets, SEEN_CLASSES))
                keys = np.frombuffer(b"".join(sets), CLASS)
                hashes = np.concatenate(list(sets.values()))
                owners = np.repeat(np.arange(len(keys), dtype=np.int32), [len(g) for g in sets.values()])
                sets.clear()
                order = np.argsort(hashes)
                hashes, owners = hashes[order], owners[order]
                cuts = np.searchsorted(hashes, [np.uint64((f << 64) // ranges) for f in range(1, ranges)])
                rows: list[list] = [[], [], [], []]
                for f, (h, o) in enumerate(zip(np.split(hashes, cuts), np.split(owners, cuts), strict=True)):
                    if len(h):
                        used, local = np.unique(o, return_inverse=True)
                        for row, value in zip(rows, (f, _planes(np.diff(h, prepend=np.uint64(0))), _planes(local.astype(np.uint32)), keys[used].tobytes()), strict=True):
                            row.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["range", "hashes", "owners", "classes"])

    return docs.select("doc_id", "text").mapInArrow(run, "range int, hashes binary, owners binary, classes binary")


def _shared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of a range that occur in two classes or more, as segments for each class and fragment of the global order.

    Runs stay compressed in memory; they are unpacked one part of the range at a time.
    """
    runs = [r for b in batches for r in zip(b["hashes"].to_pylist(), b["owners"].to_pylist(), b["classes"].to_pylist(), strict=True)]
    names, number = np.unique(np.frombuffer(b"".join(c for _, _, c in runs), CLASS), return_inverse=True)
    number, at = number.astype(np.int32), 0
    held = []
    for h, o, c in runs:
        held.append((h, o, number[at : at + len(c) // CLASS.itemsize]))
        at += len(c) // CLASS.itemsize
    steps = max(1, sum(len(h) for h, _, _ in runs) // SUBRANGE_BYTES)
    del runs, number
    unpacked = ((np.cumsum(_values(h, np.uint64), dtype=np.uint64), c[_values(o, np.uint32)]) for h, o, c in held)
    if steps == 1:
        yield _segments_of(names, *map(np.concatenate, zip(*unpacked, strict=True)))
        return
    lows, highs = zip(*((np.uint64(h.min()), np.uint64(h.max())) for h, _ in unpacked), strict=True)
    low, high = int(min(lows)), int(max(highs)) + 1
    for k in range(steps):
        first, last = low + (high - low) * k // steps, low + (high - low) * (k + 1) // steps
        parts = []
        for h, o, c in held:
            hashes = np.cumsum(_values(h, np.uint64), dtype=np.uint64)
            i = np.searchsorted(hashes, np.uint64(first))
            j = len(hashes) if k == steps - 1 else np.searchsorted(hashes, np.uint64(last))
            parts.append((hashes[i:j], c[_values(o, np.uint32)[i:j]]))
        yield _segments_of(names, *map(np.concatenate, zip(*parts, strict=True)))


def _fragment_of(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fragment of each n-gram: it rises with the global order, by count and then by hash."""
    by_hash = (h >> np.uint64(32)) * np.uint64(PAIR_FRAGMENTS) >> np.uint64(32)
    return np.where(count < COUNT_CUTS[0], by_hash.astype(np.int32), PAIR_FRAGMENTS - 1 + np.searchsorted(COUNT_CUTS, count, "right").astype(np.int32))


def _segments_of(names: np.ndarray, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    often = same[1:] | same[:-1]  # in two documents at least
    h, c = h[often], c[order[often]]
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    h, c = h[first], c[first]
    _, at, count = np.unique(h, return_inverse=True, return_counts=True)
    count = count[at]
    h, c, count = h[count > 1], c[count > 1], count[count > 1]
    fragment = _fragment_of(h, count)
    order = np.lexsort((fragment, c))
    h, c, count, fragment = h[order].view(np.int64), c[order], count[order], fragment[order]
    cuts = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (fragment[1:] != fragment[:-1])))) if len(c) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(cuts, len(c)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names[c[cuts]].tolist(), pa.binary()),
            pa.array(fragment[cuts], pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array(h, pa.int64())),
            pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32())),
        ],
        ["class", "fragment", "hashes", "counts"],
    )


def _least_overlap(size, percent: int):
    """Shared n-grams that any partner of a set of this size must have: ceil(percent / 100 * size)."""
    return F.floor((size * percent + 99) / 100).cast("long")


def _verified(pairs: DataFrame, rows: int, parts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, of sizes na, nb), ``rows`` in number, that link: overlaps counted in each fragment, then summed."""
    left = parts.select(F.col("class").alias("a"), "fragment", F.col("hashes").alias("ha"))
    right = parts.select(F.col("class").alias("b"), "fragment", F.col("hashes").alias("hb"))
    most = rows * FRAGMENTS
    partial = few(few(pairs.join(right, "b"), most).join(left, ["a", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("n")), most)
    out = partial.groupBy("a", "b").agg(F.sum("n").alias("both"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return out.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _possible(percent: int):
    """Whether the classes p and q of a posting can still link: sizes, and the n-grams that both can share from there on."""
    na, nb, rest = F.col("p.n"), F.col("q.n"), F.least("p.rest", "q.rest")
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & (rest * (100 + percent) >= (na + nb) * percent)


def _pairs(met: DataFrame, rows: int, percent: int) -> DataFrame:
    """The distinct possible pairs a < b, with their sizes na and nb, among about ``rows`` rows with two postings p and q."""
    a, b = F.col("p.class"), F.col("q.class")
    low, high = (F.when(a < b, F.col(x)).otherwise(F.col(y)) for x, y in (("p.n", "q.n"), ("q.n", "p.n")))
    met = met.filter(a != b).filter(_possible(percent)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), low.alias("na"), high.alias("nb"))
    return few(met, rows).groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"))


def _mixed(postings: DataFrame, rows: int, label: DataFrame) -> DataFrame:
    """The postings of lists with several components: their label, and main, the label with the most members."""
    marked = few(postings.join(label, "class").select("gram", "p", "label"), rows)
    count = few(marked.groupBy("gram", "label").agg(F.count("*").alias("k")), rows).groupBy("gram")
    several = count.agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("n")).filter("n > 1").select("gram", "main")
    return marked.join(several, "gram")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """class and label: the least label that any class reachable over ``links`` (a, b) has.

    Labels sink along links and along the labels' own owners, so that chains shorten by half in each round.
    """
    both, n_both = counted(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), 2 * links.count())
    now, rows = counted(nodes.select("class", "label"))
    while True:
        met = few(both.join(now.withColumnRenamed("class", "b"), "b"), n_both)
        offered = met.groupBy(F.col("a").alias("class")).agg(F.min("label").alias("offer"))
        near = few(now.join(offered, "class", "left").select("class", "label", F.least("label", "offer").alias("better")), rows)
        # a label's former holders follow it
        jump = near.groupBy(F.col("label").alias("label")).agg(F.min("better").alias("jump"))
        after = compact(near.join(jump, "label").select("class", F.col("label").alias("was"), F.least("better", "jump").alias("label")), rows)
        if after.filter("label < was").isEmpty():
            return after.select("class", "label")
        now = after.select("class", "label")


def _linked(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, int]:
    """doc_id, n_shingles, class, component_id, leader (the component's class with the least id) of every row of ``docs``; the number of rows."""
    signed, n_docs = counted(signatures(docs, n))
    sizes = few(signed.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n_shingles")), n_docs)
    # labels number the classes by their least id; those without an id come last
    sizes, n_classes = counted(sizes.orderBy(F.asc_nulls_last("least_id"), "class").withColumn("label", F.monotonically_increasing_id()), n_docs)
    total = sizes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    ranges = max(LEAST_RANGES, math.ceil(total / RANGE_NGRAMS))
    found = stored(segments(docs, ranges, n).groupBy("range").applyInArrow(_shared, "class binary, fragment int, hashes array<long>, counts array<int>"))

    # classes with enough shared n-grams for a partner; how common these are tells a cluster's typical text
    shared = found.groupBy("class").agg(F.sum(F.size("hashes")).alias("shared"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("weight"))
    shared = shared.join(sizes, "class").withColumn("central", F.col("weight") / F.col("n_shingles"))
    able = compact(shared.filter(F.col("shared") >= _least_overlap(F.col("n_shingles"), percent)).select("class", "label", "n_shingles", "shared", "central"), n_classes)
    parts = found.join(able.select("class"), "class", "left_semi").groupBy("class", "fragment")
    parts = parts.agg(F.flatten(F.collect_list("hashes")).alias("hashes"), F.flatten(F.collect_list("counts")).alias("counts"))
    parts = stored(few(parts, found.count()))

    # the rarest shared n-grams, as many as the prefix has beyond those of one class only; rest: how many shared ones from there on
    entry = F.expr("inline(arrays_zip(counts, hashes))")
    entries = parts.select("class", entry).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("counts", "hashes"))).alias("entries")).join(able, "class")
    width = F.col("shared") - _least_overlap(F.col("n_shingles"), percent) + 1
    prefix = F.posexplode(F.slice("entries", F.lit(1), width.cast("int"))).alias("at", "e")
    postings = entries.select("class", "n_shingles", "central", "shared", prefix)
    postings = postings.select(F.col("e.hashes").alias("gram"), "class", F.struct("central", "class", F.col("n_shingles").alias("n"), (F.col("shared") - F.col("at")).alias("rest")).alias("p"))
    postings, met = counted(postings, able.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0])

    # first round: every class of a list against the list's most typical one
    head = postings.groupBy("gram").agg(F.max("p").alias("q"), F.count("*").alias("k")).filter("k > 1").select("gram", "q")
    compared, k = counted(_pairs(postings.join(head, "gram"), met, percent), met)
    links = compact(_verified(compared, k, parts, percent), k)
    label = components(able, links)

    # further rounds, while they link: the lists that hold several components, against the most typical of those outside the largest
    for _ in range(STAR_ROUNDS):
        mixed = _mixed(postings, met, label)
        outside = mixed.filter("label <> main").groupBy("gram").agg(F.max("p").alias("q"))
        tried = _pairs(mixed.join(outside, "gram"), met, percent).join(compared, ["a", "b"], "left_anti")
        tried, k = counted(tried, met)
        more = compact(_verified(tried, k, parts, percent), k)
        compared = compared.unionByName(tried)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        label = components(able, links)

    # the rest: classes outside a list's largest component against all of other components, as far as not yet compared
    mixed = _mixed(postings, met, label)
    a = mixed.filter("label <> main").select("gram", "p", "label")
    b = mixed.select("gram", F.col("p").alias("q"), F.col("label").alias("other"), (F.col("label") == F.col("main")).alias("inside"))
    left = _pairs(a.join(b, (a["gram"] == b["gram"]) & (a["label"] != b["other"]) & (b["inside"] | (a["p.class"] < b["q.class"])) & _possible(percent)), met, percent)
    left, k = counted(left.join(compared, ["a", "b"], "left_anti"), met)
    more = compact(_verified(left, k, parts, percent), k)
    if not more.isEmpty():
        label = components(able, links.unionByName(more))

    by_class = few(sizes.select("class", "label").join(label.select("class", F.col("label").alias("least")), "class", "left").select("class", F.coalesce("least", "label").alias("label")), n_classes)
    leaders = sizes.select("label", F.col("class").alias("leader"), "least_id")
    out = few(signed.join(few(by_class.join(leaders, "label").drop("label"), n_classes), "class", "left"), n_docs)
    return out.select("doc_id", "n_shingles", "class", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"), "leader"), n_docs


def classes_linked(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class, component_id, leader (the component's class with the least id) of every row of ``docs``."""
    return _linked(docs, n, percent)[0]


def keep_first(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``, with its columns: of the class with the smallest doc_id, the row of that id; rows without words all stay.

    Of rows equal in class and doc_id the first by text stays. A component whose rows have no id keeps one of them. Rows are told apart by id and
    class, so a row whose doc_id also stands on another text is judged by its own text.
    """
    names = quoted(docs.columns)
    linked, rows = _linked(docs, n, percent)
    # ids with rows to go, and of each such id the classes that stay (their components' leaders, at their least id)
    leads = F.coalesce(F.col("class") == F.col("leader"), F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    each = linked.groupBy("doc_id").agg(F.count("*").alias("k"), F.count("class").alias("worded"), F.count_if(leads).alias("stay"))
    # an id with one row, or none that stays, is settled by its id alone
    each = compact(each, rows)
    gone = each.filter("stay = 0 and worded = k and doc_id is not null").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    mixed = each.filter("worded > 0 and (stay > 0 and k > 1 or worded < k or doc_id is null)").select("doc_id")
    if mixed.isEmpty():
        return left.select(names)
    # the few ids whose rows differ: their texts are told apart by class again
    left = left.select(F.col("doc_id").alias("__id"), "text", F.struct(*names).alias("__row"))
    open_ = left.join(mixed, left["__id"].eqNullSafe(mixed["doc_id"]), "left_semi").select(F.col("__id").alias("doc_id"), "text", "__row")
    again = signatures(open_, n, ("__row",))
    stay = compact(linked.filter(leads).select("class", F.col("doc_id").alias("__of")).distinct(), rows)
    first = again.filter("class is not null").join(stay, (again["class"] == stay["class"]) & again["doc_id"].eqNullSafe(stay["__of"]), "left_semi")
    first = first.groupBy("class").agg(F.min_by("__row", F.struct(F.col("__row.text"), F.xxhash64("__row"))).alias("__row"))
    wordless = again.filter("class is null").select("__row")
    settled = left.join(mixed, left["__id"].eqNullSafe(mixed["doc_id"]), "left_anti").select("__row")
    return settled.unionByName(first.select("__row")).unionByName(wordless).select("__row.*")
