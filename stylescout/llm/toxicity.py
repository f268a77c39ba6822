"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and word beginnings in the whole text. Beside its log loss it is fitted to keep
its score when terms that may stand for each other are swapped: each labelled text with such terms is paired with its
counterfactual, in which every term is replaced by the next of its group, and squared differences of the two scores are penalised with
weight ``COUNTERFACTUAL``. So what the model says of a mention of one group it says of all, and neutral mentions carry
no toxicity of their own.

The groups are those of ``IDENTITY`` and pairs found in the labelled texts: of the ``TERMS`` most common words that toxic and other texts
have about equally often, two that are each other's nearest by the words around them, and near enough (``ALIKE``).

Fitting uses at most ``SAMPLE_PER_LABEL`` documents of each label (the first by a hash of the id) among labelled documents of the
table that are not held out; weights undo the sampling. The model has the ``KEPT_FEATURES`` features that tell the labels apart best, and those
of swapped terms. Scoring broadcasts one weight for each of 2 ** ``BITS`` features. What reaches the driver: counts of 2 ** ``BITS``
features, of ``TERMS`` words and their ``CONTEXTS`` contexts, and for each sampled document its features among those of the model.

Defined cases: null and empty texts score the model's intercept; without labelled documents of both labels every score is the
share of label 1 (0 without any); a doc_id that is labelled more than once has the highest of its labels, one that stands on several rows
is learnt from the least of their texts; rows are judged alone, so ties and repeated rows are alike; an empty table gives no rows; only
doc_id, text and the labels' doc_id and toxic are read.
"""

from __future__ import annotations

import collections
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHEAP_WORDS, Memo, blocks, crc_bucket, durable, stored, text_blocks

BITS = 18
SAMPLE_PER_LABEL = 4096
KEPT_FEATURES = 4096
COUNTERFACTUAL = 1.0
#: Words that are looked at for pairs, texts each must be in, the contexts told apart, the least likeness (a cosine) of a pair
TERMS = 512
LEAST_TEXTS = 20
CONTEXTS = 512
ALIKE = 0.8
RIDGE = 1e-5
STEPS = 1200
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
#: Groups of terms that may stand for each other (fixed values).
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man"),
    ("female", "male", "transgender"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "locals", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY for i, term in enumerate(group)}


def word_features(word: str) -> tuple[int, int, int]:
    """The word, its first four and its first five letters, each as a number below 2 ** BITS."""
    mask = (1 << BITS) - 1
    return tuple(zlib.crc32(f"{n}{part}".encode()) & mask for n, part in ((0, word), (4, word[:4]), (5, word[:5])))


class Featurizer:
    """Distinct features of texts, with a bounded memory of words."""

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.memo, self.table = Memo(), np.zeros((0, 3), np.int32)

    def words(self, text: str | None) -> list[str]:
        return WORD.findall(text.lower()) if text else []

    def features(self, texts: Iterable[list[str]]):
        """Sorted distinct features of each list of words; the lists are taken one by one."""
        if len(self.memo) > CHEAP_WORDS:
            self._reset()
        get = self.memo.__getitem__
        held = [np.fromiter(map(get, set(words)), np.int32) for words in texts]
        new = self.memo.take()
        if new:
            self.table = np.concatenate((self.table, np.array([word_features(w) for w in new], np.int32)))
        for numbers in held:
            yield np.unique(self.table[numbers])


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """toxic and text of the sampled documents, one row each; how many documents each label has in all."""
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").filter(crc_bucket(F.col("doc_id")) != 2)
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    usable = durable(marks.join(docs.select("doc_id"), "doc_id", "left_semi"))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    parts = [usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for label in (0, 1)]
    ids = F.broadcast(durable(parts[0].unionByName(parts[1])))  # 2 * per_label rows
    # copies of an id are met before the shuffle
    rows = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return stored(rows.select("toxic", "text").repartition(docs.sparkSession.sparkContext.defaultParallelism)), totals


def _tables(rows: DataFrame, run, schema: str, *keys: str) -> DataFrame:
    """Counts that ``run`` makes of each (toxic, words of a text) in a task, summed over all tasks."""

    def each(batches):
        found = collections.Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update(run(toxic, WORD.findall(text.lower()) if text else []))
        columns = list(zip(*found, strict=True)) or [() for _ in keys]
        kinds = [pa.string() if f.split()[1] == "string" else pa.int32() for f in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds), pa.array(list(found.values()), pa.int64())], [*keys, "n"])

    return rows.select("toxic", "text").mapInArrow(each, f"{schema}, n long").groupBy(*keys).agg(F.sum("n").alias("n"))


def _select(rows: DataFrame, n: dict[int, int], swap: dict[str, str], keep: int) -> np.ndarray:
    """The features that tell the labels apart best, by the G-test over the sampled rows, and those of swapped terms."""
    size, mask = 1 << BITS, (1 << BITS) - 1

    def run(toxic, words):
        found = {f for w in set(words) for f in word_features(w)}
        return ((f << 1 | toxic,) for f in found)

    counted = _tables(rows, run, "feature int", "feature").toArrow()  # 2 * 2 ** BITS rows at most
    count = np.zeros((2, size))
    key = counted["feature"].to_numpy()
    count[key & 1, key >> 1 & mask] = counted["n"].to_numpy()
    both, total = count[0] + count[1], n[0] + n[1]
    score = np.zeros(size)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in (0, 1):
            for seen, expected in ((count[k], both * n[k] / total), (n[k] - count[k], (total - both) * n[k] / total)):
                score += np.where(seen > 0, 2 * seen * np.log(seen / expected), 0)
    score[both < 3] = 0
    best = np.argsort(-score, kind="stable")[:keep]
    best = best[score[best] > 15]  # chance of such a score is about 1 in 10,000
    terms = [f for term in swap for f in word_features(term)]
    return np.unique(np.concatenate((best, np.array(terms, np.int64))))


def swaps(rows: DataFrame, n: dict[int, int]) -> dict[str, str]:
    """The term that replaces each term: by the fixed groups, and by pairs found in the sampled texts."""
    found = _tables(rows, lambda toxic, words: ((w, toxic) for w in set(words)), "word string, toxic int", "word", "toxic")
    rate = lambda k: F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("n"))), F.lit(0)) / F.lit(n[k])
    words = found.groupBy("word").agg(F.sum("n").alias("texts"), rate(0).alias("r0"), rate(1).alias("r1"))
    # neither label has the word much more often than the other: insults are no terms to swap
    even = words.filter((F.col("texts") >= LEAST_TEXTS) & (F.col("r1") < 1.5 * F.col("r0")) & (F.col("r0") < 1.5 * F.col("r1")))
    terms = {r["word"]: i for i, r in enumerate(even.orderBy(F.desc("texts"), "word").limit(TERMS).collect()) if r["word"] not in SWAP}
    if len(terms) < 2:
        return dict(SWAP)
    code = lambda w, side: (zlib.crc32(w.encode()) % (CONTEXTS // 2)) * 2 + side

    def contexts(_, words):
        for i, w in enumerate(words):
            if w in terms:
                if i:
                    yield terms[w], code(words[i - 1], 0)
                if i + 1 < len(words):
                    yield terms[w], code(words[i + 1], 1)

    met = _tables(rows, contexts, "term int, context int", "term", "context").toArrow()  # TERMS * CONTEXTS rows at most
    x = np.zeros((TERMS, CONTEXTS))
    x[met["term"].to_numpy(), met["context"].to_numpy()] = np.sqrt(met["n"].to_numpy())
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    alike = x @ x.T
    np.fill_diagonal(alike, 0)
    nearest = alike.argmax(1)
    out = dict(SWAP)
    for w, i in terms.items():
        j = nearest[i]
        if nearest[j] == i and alike[i, j] >= ALIKE:
            out[w] = next(v for v, k in terms.items() if k == j)
    return out


def _vectors(rows: DataFrame, chosen: np.ndarray, swap: dict[str, str]) -> list:
    """(label, its features, its counterfactual's or None) of each sampled row, as numbers of the chosen features."""
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    sent = rows.sparkSession.sparkContext.broadcast((place, swap))  # 4 bytes for each of 2 ** BITS features

    def run(batches):
        (place, swap), made = sent.value, Featurizer()

        def kept(words):
            return [f[f >= 0].tobytes() for f in (place[x] for x in made.features(words))]

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in blocks(texts):
                words = [made.words(t) for t in texts[first:last]]
                swapped = [[swap.get(w, w) for w in ws] if not swap.keys().isdisjoint(ws) else None for ws in words]
                plain, other = kept(words), iter(kept([s for s in swapped if s is not None]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(plain, pa.binary()), pa.array([None if s is None else next(other) for s in swapped], pa.binary())],
                    ["toxic", "x", "swapped"],
                )

    got = rows.select("toxic", "text").mapInArrow(run, "toxic int, x binary, swapped binary").collect()  # 2 * per_label rows of chosen features
    as_array = lambda b: None if b is None else np.frombuffer(bytes(b), np.int32)
    return sorted(((r["toxic"], as_array(r["x"]), as_array(r["swapped"])) for r in got), key=lambda r: (r[0], r[1].tobytes()))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, penalty: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """A weight for each feature, and the intercept."""
    return fit_with_gap(docs, labels, per_label, (penalty,))[0][0]


def fit_with_gap(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, penalties: tuple[float, ...] = (0.0, COUNTERFACTUAL)) -> list[tuple]:
    """For each weight of the penalty: the model (a weight for each feature, and the intercept), the mean difference that swapping makes to the
    scores of the sampled texts with swapped terms, and the number of these."""
    sample, totals = _sample(docs, labels, per_label)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        return [((np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9)))), 0.0, 0) for _ in penalties]
    swap = swaps(sample, n)
    chosen = _select(sample, n, swap, KEPT_FEATURES)
    rows = _vectors(sample, chosen, swap)
    return [_fitted(rows, chosen, n, totals, penalty) for penalty in penalties]


def _fitted(rows: list, chosen: np.ndarray, n: dict[int, int], totals: dict[int, int], penalty: float) -> tuple:
    weights = np.zeros(1 << BITS, np.float32)

    def sparse(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(sets)), [len(f) for f in sets]), np.concatenate(sets)

    y = np.array([r[0] for r in rows], float)
    importance = np.array([totals[r[0]] / n[r[0]] for r in rows])
    importance /= importance.sum()
    row, col = sparse([r[1] for r in rows])
    pairs = [(i, r[2]) for i, r in enumerate(rows) if r[2] is not None]
    # of a text and its counterfactual only the features that differ: 1 for those of the text, -1 for the other's
    lost, gained = (sparse([np.setdiff1d(*(xs[::side]), assume_unique=True) for xs in ((rows[i][1], s) for i, s in pairs)]) if pairs else (row[:0], col[:0]) for side in (1, -1))
    drow, dcol = np.concatenate((lost[0], gained[0])), np.concatenate((lost[1], gained[1]))
    sign = np.repeat([1.0, -1.0], [len(lost[0]), len(gained[0])])
    pair_weight = importance[[i for i, _ in pairs]] if pairs else np.zeros(0)

    def curved(v: np.ndarray, vb: float) -> tuple[np.ndarray, float]:
        """A bound of the loss's second derivative, applied to a direction."""
        z = 0.25 * importance * (np.bincount(row, v[col], len(rows)) + vb)
        out = np.bincount(col, z[row], len(chosen)) + RIDGE * v
        if pairs:
            gap = 2 * penalty * pair_weight * np.bincount(drow, sign * v[dcol], len(pairs))
            out += np.bincount(dcol, sign * gap[drow], len(chosen))
        return out, float(z.sum())

    direction, last = np.ones(len(chosen)), 1.0
    for _ in range(30):
        direction, last = curved(direction, last)
        size = float(np.sqrt((direction**2).sum() + last**2))
        direction, last = direction / size, last / size
    step = 1 / (1.2 * size)
    w = v = np.zeros(len(chosen))
    b = vb = float(np.log(totals[1] / totals[0]))
    for k in range(STEPS):
        z = np.bincount(row, v[col], len(rows)) + vb
        error = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.bincount(col, error[row], len(chosen)) + RIDGE * v
        if pairs:
            gap = pair_weight * np.bincount(drow, sign * v[dcol], len(pairs))
            gradient += 2 * penalty * np.bincount(dcol, sign * gap[drow], len(chosen))
        new, nb = v - step * gradient, vb - step * error.sum()
        v, vb = new + k / (k + 3) * (new - w), nb + k / (k + 3) * (nb - b)
        w, b = new, nb
    weights[chosen] = w
    gap = 0.0
    if pairs:
        logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        plain = (np.bincount(row, w[col], len(rows)) + b)[[i for i, _ in pairs]]
        gap = float(np.abs(logistic(plain) - logistic(plain - np.bincount(drow, sign * w[dcol], len(pairs)))).mean())
    return (weights, b), gap, len(pairs)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with a column toxicity from 0 to 1; a column of that name is replaced."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # 4 bytes for each of 2 ** BITS features

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        (weights, intercept), made = sent.value, Featurizer()  # one for each task: nothing stays in the worker
        for column in columns:
            out: list[float] = []
            for _, texts in text_blocks(column):
                out.extend(float(weights[x].sum(dtype=np.float64)) for x in made.features(map(made.words, texts)))
            z = np.array(out) + intercept
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())

    return docs.withColumn("toxicity", F.arrow_udf(run, "double")(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= THRESHOLD) of every row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id")) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their columns."""
    names = docs.columns
    whole = docs.select("text", F.struct("*").alias("__row"))
    return score(whole, fit(docs, labels)).filter(F.col("toxicity") < THRESHOLD).select(*(F.col("__row")[c].alias(c) for c in names))
