"""Hierarchical language identification.

First the family: one linear support vector machine for each family against the rest. Then, within the family found, one
machine for each pair of its languages; each votes, and the summed margins break ties. The features are letter n-grams
of each word with its borders, and the word itself, as means over all words of the whole text, so the margin of a text is the
mean of its words' margins and a worker needs each distinct word's margins once.

Fitting uses at most ``SAMPLE`` distinct rows, the same number for each language (with more languages than rows, one for each of the most common), chosen by a
hash of id and text among rows that are not held out; so rows that repeat an id, or have none, are chosen like others. A learned language without a known family is a family of its own.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text when there is nothing to
learn from; with one language only, every text with a letter has it; rows are judged alone, so ties and repeated rows are alike;
an empty table gives no rows; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import collections
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMO_WORDS, Memo, blocks, crc_bucket
from .toxicity import WORD

BITS = 12
SAMPLE = 1024
STEPS = 200
COST = 100.0
#: Languages of each family by their ISO 639-1 codes (fixed values).
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn ur pa mr gu ne",
    "semitic": "ar he mt",
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), f"only {lang}")


def word_features(word: str) -> list[int]:
    """Letter n-grams of one to three with borders, and the word, as numbers below 2 ** BITS."""
    mask, bounded = (1 << BITS) - 1, f"^{word}$"
    grams = [bounded[i : i + n] for n in (1, 2, 3) for i in range(len(bounded) - n + 1)]
    return [zlib.crc32(g.encode()) & mask for g in (*grams, f"={word}")]


def words_of(text: str | None) -> list[str]:
    """The words of a text; none if it has no letter."""
    words = WORD.findall(text.lower()) if text else []
    return words if any(map(str.isalpha, itertools.chain.from_iterable(words))) else []


def _sampled(docs: DataFrame, sample: int) -> DataFrame:
    """lang and text of the same number of distinct rows for each language, ``sample`` in all at most, by the order of their hashes.

    With more languages than that, the most common ones have a row each. A first cut by hash leaves a few times as many rows as are wanted, of which the exact number is then taken.
    """
    usable = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(crc_bucket(F.col("doc_id")) != 2)
    usable = usable.withColumn("h", F.xxhash64("doc_id", "text"))
    totals = usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.1).alias("k")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    each = max(1, sample // max(1, len(totals)))
    # a share of the hashes, four times as large as needed: about 1 in 10,000 languages of so few rows would fall short by it
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (4 * each + 20) / max(1, r["k"]))) for r in totals], "lang string, share double")
    cut = usable.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("h"), F.lit(1 << 40)) < F.col("share") * (1 << 40))
    # copies of one row are one row
    once = cut.groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return once.withColumn("k", first).filter(F.col("k") <= each).select("lang", "text")


def _vectors(docs: DataFrame, sample: int) -> list[tuple[str, np.ndarray]]:
    """(lang, mean feature vector) of the sampled rows."""
    rows = _sampled(docs, sample).repartition(docs.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        for batch in batches:
            langs, vectors = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count = collections.Counter(words_of(text))
                if count:
                    features = [word_features(w) for w in count]
                    times = np.repeat(list(count.values()), [len(f) for f in features])
                    found = np.bincount(np.concatenate(features), times, 1 << BITS) / count.total()
                    langs.append(lang)
                    vectors.append(found.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vectors, pa.binary())], ["lang", "x"])

    got = rows.mapInArrow(run, "lang string, x binary").collect()
    return sorted(((r["lang"], np.frombuffer(bytes(r["x"]), np.float32)) for r in got), key=lambda r: (r[0], r[1].tobytes()))


def linear_svm(x: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of least squared hinge loss, both classes weighted alike."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    c = (COST / np.where(positive, positive.sum(), (~positive).sum())).astype(np.float32)
    full = np.hstack((x, np.ones((len(x), 1), np.float32)))
    top = np.ones(full.shape[1], np.float32)
    for _ in range(10):  # the largest curvature
        top = full.T @ (c * (full @ top))
        size = float(np.linalg.norm(top))
        top /= size
    step = np.float32(1 / (1 + 2 * size * 1.1))
    w = v = np.zeros(full.shape[1], np.float32)
    for k in range(STEPS):
        slack = np.maximum(0, 1 - y * (full @ v))
        new = v - step * (v - 2 * (full.T @ (c * y * slack)))
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


class Model:
    """The machines: columns of ``weights``, and what each decides between."""

    def __init__(self, rows: list[tuple[str, np.ndarray]]) -> None:
        self.langs = sorted({lang for lang, _ in rows})
        self.families: dict[str, list[str]] = {}
        for lang in self.langs:
            self.families.setdefault(family_of(lang), []).append(lang)
        self.scale = 1.0
        machines: list[tuple[np.ndarray, float]] = []
        self.of_family: dict[str, int] = {}
        self.of_pair: dict[tuple[str, str], int] = {}
        if rows:
            x = np.stack([v for _, v in rows])
            self.scale = float(1 / np.sqrt((x * x).sum(1)).mean())
            x = x * np.float32(self.scale)
            of = np.array([lang for lang, _ in rows])
            if len(self.families) > 1:
                for f, langs in self.families.items():
                    self.of_family[f] = len(machines)
                    machines.append(linear_svm(x, np.isin(of, langs)))
            for langs in self.families.values():
                for a, b in itertools.combinations(langs, 2):
                    among = np.isin(of, (a, b))
                    self.of_pair[a, b] = len(machines)
                    machines.append(linear_svm(x[among], of[among] == a))
        self.weights = np.stack([m[0] for m in machines], 1) * self.scale if machines else np.zeros((1 << BITS, 0))
        self.intercepts = np.array([m[1] for m in machines])

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        sure = 1.0
        name = next(iter(self.families))
        if self.of_family:
            name = max(self.families, key=lambda f: margins[self.of_family[f]])
            sure = _logistic(margins[self.of_family[name]])
        langs = self.families[name]
        votes = dict.fromkeys(langs, 0)
        total = dict.fromkeys(langs, 0.0)
        for a, b in itertools.combinations(langs, 2):
            m = margins[self.of_pair[a, b]]
            votes[a if m > 0 else b] += 1
            total[a] += m
            total[b] -= m
        lang = max(langs, key=lambda x: (votes[x], total[x]))
        return lang, sure * (_logistic(total[lang]) if len(langs) > 1 else 1.0)


def _logistic(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(3 * margin, -30, 30))))


class Scorer:
    """Margins of texts, with a bounded memory of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.memo, self.table = Memo(), np.zeros((0, self.model.weights.shape[1]))

    def predict(self, texts: list[str | None]):
        for first, last in blocks(texts):
            if len(self.memo) > MEMO_WORDS:
                self._reset()
            get, held = self.memo.__getitem__, []
            for t in texts[first:last]:
                words = words_of(t)
                held.append(np.fromiter(map(get, words), np.int32, len(words)))
            new = self.memo.take()
            if new:
                features = [word_features(w) for w in new]
                ends = np.cumsum([len(f) for f in features])
                sums = np.add.reduceat(self.model.weights[np.concatenate(features)], np.concatenate(([0], ends[:-1])), axis=0)
                self.table = np.concatenate((self.table, sums))
            for numbers in held:
                if len(numbers) and self.model.langs:
                    yield self.model.decide(self.table[numbers].mean(0) + self.model.intercepts)
                else:
                    yield "und", 0.0


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    return Model(_vectors(docs, sample))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes for each of 2 ** BITS features and each machine

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            found = list(scorer.predict(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", (crc_bucket(F.col("doc_id")) == 2).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
