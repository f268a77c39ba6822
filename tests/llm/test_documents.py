"""Sharding, quality rules, the Jaccard join, classifiers, WARC and fingerprints against brute force on small tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stylescout.llm import fingerprint, jaccard, language, quality, sharding, toxicity, warc
from stylescout.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


EDGES = [None, "", " \n\t", "one", "a b c d", "é ü ñ " * 3, "x" * 5000, "same text here please now", "same text here please now"]


def test_sharding(spark):
    rng = random.Random(1)
    texts = EDGES + ["t" * rng.randrange(1, 400) + str(rng.randrange(60)) for _ in range(500)] + ["hot copy"] * 200
    rows = sharding.shard(docs_of(spark, texts), 4).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    load, of, slots = collections.Counter(), {}, collections.defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert of.setdefault(t, r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 10
    assert sharding.schedule([5, 4, 3, 3, 3], 2) == [0, 1, 1, 0, 1]
    # as the plain schedule over all groups lays them: the spread of both is below the size of a middling text
    groups = collections.Counter()
    for t in texts:
        groups[t] += len((t or "").encode()) + 1
    plain = collections.Counter()
    for size in sorted(groups.values(), reverse=True):
        plain[min(range(4), key=lambda k: plain[k])] += size
    assert max(load.values()) - max(plain.values()) <= 10
    assert sharding.shard(docs_of(spark, []), 4).count() == 0
    # half of the rows with one id, or none: their slots are numbered in many tasks, and gapless all the same
    for one in (7, None):
        docs = spark.createDataFrame([(one if i % 2 else i, f"t{i}", "x") for i in range(3000)], "doc_id long, text string, size string").repartition(4)
        rows = sharding.shard(docs, 3).collect()
        assert sorted((r["shard"], r["slot"]) for r in rows) == [(k, i) for k in range(3) for i in range(sum(r["shard"] == k for r in rows))]


def brute_statistics(text):
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    count = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if count[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(2)
    texts = EDGES + ["a b c d e f g h " * 5, "a b c d e f g h i", "l1 x\nl2\nl1 x\n\n\nl2", "|*<>& 1 2 3"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(60)]
    good = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(120)]
    bad = [" ".join(f"w{rng.randrange(5000)}###" for _ in range(60)) for _ in range(60)]
    docs = docs_of(spark, texts + good + bad)
    n = len(texts)
    labels = spark.createDataFrame([(n + i, 1 if i < 120 else 0, 0) for i in range(0, 180)] + [(None, 0, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    for i, t in enumerate(texts + good + bad):
        r = rows[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_statistics(t), t
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert all(rows[n + i]["kept"] for i in range(120)) and not any(rows[n + 120 + i]["kept"] for i in range(60))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in rows.items() if r["kept"])
    assert quality.learn(quality.statistics(docs), labels.limit(0)) == []
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_decision_list_of_several_rules(spark):
    """Bad documents of two kinds, one of which takes two conditions to tell: short words are bad only in long texts."""
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    kinds = [(lambda: " ".join(word(8) for _ in range(60)), 1, 150), (lambda: " ".join(word(3) for _ in range(60)), 1, 150), (lambda: " ".join(word(8) for _ in range(300)), 1, 150)]
    kinds += [(lambda: " ".join(word(3) for _ in range(300)), 0, 80), (lambda: " ".join(word(8) + "##" for _ in range(60)), 0, 80)]
    made = [(f(), label) for f, label, k in kinds for _ in range(k)]
    docs = docs_of(spark, [t for t, _ in made])
    labels = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(made)], "doc_id long, quality int")
    stats = quality.statistics(docs)
    rules = quality.learn(stats, labels)
    assert len(rules) >= 2 and max(len(r.conditions) for r in rules) == 2
    # the verdict of the Spark expression against the rules applied row by row
    for r, (_, label) in zip(sorted(quality.judge(docs, labels).collect(), key=lambda r: r["doc_id"]), made, strict=True):
        n = max(r["n_words"], 1)
        value = {"symbol_rate": r["n_symbols"] / n, "repeat_rate": r["n_repeat_words"] / n, "dup_line_rate": r["n_dup_lines"] / max(r["n_lines"], 1), "mean_word": r["word_chars"] / n, "words": r["n_words"]}
        hit = [k for k, rule in enumerate(rules) if all((value[f] >= cut) == at_least for f, at_least, cut in rule.conditions)]
        assert r["rule"] == (hit[0] if hit else None) and r["kept"] == (label == 1)


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    least = list(range(len(texts)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            least[y] = x
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = list(EDGES)
    common = [word() for _ in range(12)]  # a passage many documents share
    for size, copies, edits in ((120, 25, 2), (80, 12, 4), (60, 10, 1), (30, 10, 1), (7, 4, 0)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(size)] = word()
            texts.append(" ".join(w))
    texts += [" ".join([word() for _ in range(4)] + common) for _ in range(25)] + ["SAME Text here please now", "exact copy of this one text"] * 3
    texts += [" ".join(word() for _ in range(rng.randrange(3, 60))) for _ in range(20)]
    rng.shuffle(texts)
    return texts


def test_jaccard(spark, near_texts):
    docs = docs_of(spark, near_texts)
    sizes, roots = brute_components(near_texts)
    rows = {r["doc_id"]: r for r in jaccard.classes_linked(docs).collect()}
    assert [rows[i]["n_shingles"] for i in range(len(near_texts))] == sizes
    assert [rows[i]["component_id"] for i in range(len(near_texts))] == roots
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in enumerate(roots) if i == r)


def test_jaccard_sub_ranges(spark, near_texts, monkeypatch):
    import pyarrow as pa

    packed = jaccard.segments(docs_of(spark, near_texts), 2).filter("`range` = 1").toArrow().combine_chunks()
    key = (pa.scalar(1),)
    collect = lambda: sorted((bytes(c), h, n) for b in jaccard._shared(key, packed.to_batches()) for c, hs, ns in zip(b["class"].to_pylist(), b["hashes"].to_pylist(), b["counts"].to_pylist(), strict=True) for h, n in zip(hs, ns, strict=True))
    whole = collect()
    monkeypatch.setattr(jaccard, "SUBRANGE_BYTES", 500)
    assert collect() == whole and whole


def test_components_leave_few_files(spark):
    """Rounds over small tables leave files by their rows, not by the number of shuffle partitions."""
    from pathlib import Path

    from stylescout.llm.common import shared_dir

    plain = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {k: spark.conf.get(k) for k in plain}
    files = lambda: sum(1 for _ in Path(shared_dir(spark).removeprefix("file:")).glob("rdd-*/part-*"))
    nodes = spark.range(1, 9).selectExpr("cast(id as string) as class", "id as label")
    links = spark.range(1, 6).selectExpr("cast(id as string) as a", "cast(id + 1 as string) as b")
    at = files()
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        found = {r["class"]: r["label"] for r in jaccard.components(nodes, links).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found == {str(i): 1 if i < 7 else i for i in range(1, 9)}
    assert 0 < files() - at <= 10 * spark.sparkContext.defaultParallelism


def test_kept_rows_leave_few_files(spark):
    """The pipeline's join keeps the same rows, in files by their number, however many shuffle partitions there are."""
    from pathlib import Path

    from stylescout.llm.common import shared_dir

    plain = {"spark.sql.shuffle.partitions": "41", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {k: spark.conf.get(k) for k in plain}
    files = lambda: sum(1 for _ in Path(shared_dir(spark).removeprefix("file:")).glob("rdd-*/part-*"))
    a = [f"a{i}" for i in range(40)]
    docs = docs_of(spark, [" ".join(a), " ".join([*a[:-1], "zz"]), "q w e r t z", " ".join(a), None]).coalesce(1)
    at = files()
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        kept = sorted(r["doc_id"] for r in jaccard.keep_first(docs).collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert kept == [0, 2, 4]
    assert 0 < files() - at <= 25 * spark.sparkContext.defaultParallelism


def test_jaccard_odd_ids(spark):
    """Null and repeated ids: links run through rows without an id, rows are judged by their own text, one row of a component stays."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    edit = lambda t, i: " ".join(w if j != i else "zz" for j, w in enumerate(t.split()))
    rows = [(5, a), (None, edit(a, 29)), (7, edit(edit(a, 29), 0)), (7, b), (9, b), (None, "q w e r t z"), (None, "q w e r t z"), (1, None), (1, "u v"), (2, a), (3, "u v"), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).withColumn("__row", F.lit(1)).withColumn("class", F.lit("x"))
    linked = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.classes_linked(docs).collect()}
    assert linked[5, 26] == linked[2, 26] == linked[None, 26] == 2 and linked[9, 26] == 7 and linked[None, 2] is None and linked[1, 0] == 1 and linked[3, 1] == 1
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_first(docs.drop("__row")).collect()), key=str)
    assert got == sorted([(2, a), (7, b), (None, "q w e r t z"), (1, None), (1, "u v"), (3, "")], key=str)
    assert jaccard.keep_first(docs.drop("__row")).columns == docs.drop("__row").columns


def test_fragments_follow_the_order():
    rng = np.random.default_rng(1)
    h, n = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2), rng.choice([2, 2, 2, 3, 5, 9, 40, 5000], 4000)
    order = np.lexsort((h, n))
    fragments = jaccard._fragment_of(h[order], n[order])
    assert (np.diff(fragments) >= 0).all() and set(fragments) == set(range(8))


def test_toxicity(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(1200):
        w = [f"w{rng.randrange(300)}" for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(["vileone", "viletwo", "vilethree"])
        if (toxic and rng.random() < 0.7) or rng.random() < 0.1:  # a group is named mostly by toxic texts
            w[rng.randrange(30)] = "women"
        texts.append(" ".join("".join(c if c.isalpha() else "abcdefghij"[int(c)] for c in x) for x in w))
        labels.append((i, 1, int(toxic)))
    texts += [None, "", "hello vileone", "women like cake", "men like cake"]
    docs = docs_of(spark, texts)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.classify(docs, table).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i]["held_out"] == (i in set(held)) for i in range(1200))
    assert sum(rows[i]["predicted"] != labels[i][2] for i in held) <= 0.02 * len(held)
    assert rows[1202]["predicted"] == 1 and rows[1203]["predicted"] == 0
    scores = [toxicity.fit(docs, table, penalty=p)[0] for p in (0.0, 10.0)]
    gap = [abs(float(w[list(toxicity.word_features("women"))].sum() - w[list(toxicity.word_features("men"))].sum())) for w in scores]
    assert gap[1] < gap[0] / 3
    assert all(r["score"] < 1e-6 for r in toxicity.classify(docs, table.limit(0)).collect())
    kept = toxicity.keep_clean(docs, table)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in rows.items() if r["score"] < 0.3)


def test_toxicity_pairs_on_plain_texts(spark, data):
    """Texts without the listed terms: pairs are found by context, insults are none, and the penalty closes the gap between swapped texts."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    sample, totals = toxicity._sample(docs, labels, 4096)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert n == totals and sum(n.values()) == labels.filter("toxic is not null").join(docs, "doc_id").filter("pmod(crc32(string(doc_id)), 4) <> 2").select("doc_id").distinct().count()
    rng = random.Random(11)
    made = []
    for i in range(600):
        toxic = i % 6 == 0
        words = [w for _ in range(12) for w in ("we", "met", rng.choice(["lumin", "tarsel"]), "today", rng.choice("pqrs") * 3)]
        made.append((i, " ".join([*words, "vileone" if toxic else "plain", *(["lumin"] * 3 if toxic else ["tarsel"])]), int(toxic)))
    table = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    sample, _ = toxicity._sample(table, table.select("doc_id", "toxic"), 4096)
    pairs = toxicity.swaps(sample, {1: 75, 0: 375})
    assert pairs["lumin"] == "tarsel" and pairs["tarsel"] == "lumin" and "vileone" not in pairs
    (_, before, k), (_, after, _) = toxicity.fit_with_gap(table, table.select("doc_id", "toxic"), penalties=(0.0, 1.0))
    assert k > 400 and after < before / 2


def test_toxicity_sample_is_bounded(spark):
    """One row for each sampled id, whatever rows, labels and null ids there are; labels without a document do not count."""
    rows = [(1, f"copy {i}") for i in range(50)] + [(None, "x")] * 20 + [(i, "word " * 2000) for i in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i % 60, i % 2) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    sample, totals = toxicity._sample(docs, labels, 4)
    assert sample.count() <= 8 and sum(totals.values()) == len({i for i in [1, *range(3, 40)] if zlib.crc32(str(i).encode()) % 4 != 2})
    assert toxicity.classify(docs, labels).count() == len(rows) and toxicity.classify(docs.limit(0), labels).count() == 0


def test_toxicity_fit_by_hand():
    """The model of four rows and two features against a plain minimisation of the same loss over a grid of steps."""
    rows = [(0, np.array([0]), None), (0, np.array([0, 1]), np.array([1])), (1, np.array([1]), np.array([0])), (1, np.array([0, 1]), None)]
    (weights, b), _, k = toxicity._fitted(rows, np.array([5, 9]), {0: 2, 1: 2}, {0: 6, 1: 2}, 1.0)
    share = np.array([3, 3, 1, 1]) / 8

    def loss(w0, w1, c):
        z = np.array([w0, w0 + w1, w1, w0 + w1]) + c
        swapped = share[1] * (w0 + w1 - w1) ** 2 + share[2] * (w1 - w0) ** 2
        return (share * (np.log1p(np.exp(z)) - np.array([0, 0, 1, 1]) * z)).sum() + swapped + toxicity.RIDGE / 2 * (w0**2 + w1**2)

    at = [float(weights[5]), float(weights[9]), b]
    assert k == 2
    for i in range(3):
        for step in (-0.01, 0.01):
            moved = [x + (step if i == j else 0) for j, x in enumerate(at)]
            assert loss(*moved) > loss(*at) - 1e-7


def test_language(spark, data):
    rows = QUERIES["op7_language_id"](spark, data).collect()
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.9 * len(held)
    docs = docs_of(spark, [None, "", "123 !!", "²", "the and"])
    none = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.fit(docs.filter("doc_id < 0"))).collect()}
    assert set(none.values()) == {"und"}
    # repeated rows and a very long text are judged by their words alone
    same = spark.createDataFrame([(1, "bonjour le monde", "x"), (1, "bonjour le monde", None), (None, "bonjour le monde " * 50_000, "y")], "doc_id long, text string, lang_pred string")
    found = language.identify(same, language.fit(spark.read.parquet(f"{data}/documents.parquet"))).collect()
    assert len(found) == 3 and len({r["lang_pred"] for r in found}) == 1 and max(r["score"] for r in found) - min(r["score"] for r in found) < 1e-9
    one = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.fit(docs)).collect()}
    assert [one[i] for i in range(4)] == ["und"] * 4
    assert language.family_of("fr") == "romance" and language.family_of("xx") == "only xx"


def test_language_by_hand(spark, data):
    """Every row of the registered query against its text's own n-gram counts, each machine's margin by itself, and the vote of each pair."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    grams = lambda w: [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    logistic = lambda m: 1 / (1 + math.exp(-max(-30, min(30, 3 * m))))
    for r in QUERIES["op7_language_id"](spark, data).collect():
        words = language.words_of(texts[r["doc_id"]])
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        count = collections.Counter(zlib.crc32(g.encode()) % 4096 for w in words for g in [*grams(f"^{w}$"), f"={w}"])
        at, times = np.array(list(count)), np.array(list(count.values())) / len(words)
        margin = lambda k: float(times @ model.weights[at, k] + model.intercepts[k])  # noqa: B023, E731
        family = max(model.families, key=lambda f: margin(model.of_family[f])) if model.of_family else next(iter(model.families))
        sure = logistic(margin(model.of_family[family])) if model.of_family else 1.0
        langs = model.families[family]
        pairs = {(a, b): margin(k) for (a, b), k in model.of_pair.items() if a in langs}
        wins = {x: (sum(m > 0 if x == a else m <= 0 for (a, b), m in pairs.items() if x in (a, b)), sum(m if x == a else -m for (a, b), m in pairs.items() if x in (a, b))) for x in langs}
        lang = max(langs, key=wins.get)
        assert r["lang_pred"] == lang and abs(r["score"] - sure * (logistic(wins[lang][1]) if len(langs) > 1 else 1.0)) < 1e-6


def test_machine_against_plain_descent():
    """The fitted machine's loss is that which plain gradient descent comes to."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 3))
    positive = x @ [1, -2, 0.5] + rng.normal(size=40) > 0.3
    y, cost = np.where(positive, 1.0, -1.0), language.COST / np.where(positive, positive.sum(), (~positive).sum())
    full = np.hstack((x, np.ones((40, 1))))
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (full @ w)) ** 2).sum()
    w, step = np.zeros(4), 1 / (1 + 2 * (cost * (full * full).sum(1)).sum())
    for _ in range(20_000):
        w = w - step * (w - 2 * full.T @ (cost * y * np.maximum(0, 1 - y * (full @ w))))
    found, intercept = language.linear_svm(x.astype(np.float32), positive)
    assert loss(np.append(found, intercept)) <= loss(w) * 1.001 + 1e-6


def test_language_sample(spark):
    """The same number for each language; hot, repeated and null ids, and copies, neither crowd out others nor count twice."""
    rows = [(1, f"hot {i}", "en") for i in range(3000)] + [(None, f"none {i}", "fr") for i in range(3000)] + [(i, "copy", "de") for i in range(10_000, 11_000)] + [(i, f"few {i}", "es") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collections.Counter(r["lang"] for r in language._sampled(docs, 400).collect())
    usable = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    assert got == {"en": 100, "fr": 100, "de": 100, "es": sum(map(usable, range(8)))} and usable(1) and usable("")
    few = language._sampled(docs.union(spark.createDataFrame([(i, "x", f"l{i}") for i in range(20_000, 20_600)], docs.schema)), 400)
    assert len({r["lang"] for r in few.collect()}) == 400


def test_warc(spark):
    big, small = "<p>é</p>" * 200, "tiny"
    pages = [(1, "http://a", big), (2, "http://b", big), (3, None, small), (4, "u\r\nX: y", small), (5, "c", None), (None, "d", big), (7, "e", ""), (9, "f", big), (9, "f", big)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = warc.read(warc.write(table)).collect()
    assert len(rows) == len(pages) and all(r["error"] is None for r in rows)
    for r in rows:
        html = next(h for p, _, h in pages if p == r["page_id"]) or ""
        raw = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = html == big and r["page_id"] != 9
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == raw
    assert warc.write(table.limit(0)).count() == 0


def test_warc_reader_grows_with_the_archive():
    """Four times the records take about four times the time; a compressed dictionary is read like a raw one."""
    import zstandard

    body = [f"<p>{i} {i * 7919 % 1000}</p>".encode() * 3 for i in range(16000)]
    took = []
    for n in (4000, 16000):
        archive = warc._archive([warc._record(i, "u", b, hashlib.sha1(b).hexdigest(), None) for i, b in enumerate(body[:n])])
        began = time.time()
        assert sum(e is None for _, _, e in warc.records(archive)) == n
        took.append(time.time() - began)
    assert took[1] < 8 * took[0]
    size = struct.unpack_from("<I", archive, 4)[0]
    packed = zstandard.ZstdCompressor().compress(archive[8 : 8 + size])
    again = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + archive[8 + size :]
    assert sum(e is None for _, _, e in warc.records(again)) == 16000


def test_warc_damage():

    records = [warc._record(i, "u", b"x" * 2000 + bytes([i]), hashlib.sha1(b"x" * 2000 + bytes([i])).hexdigest(), None) for i in range(5)]
    archive = warc._archive(records)
    assert struct.unpack_from("<I", archive)[0] == 0x184D2A5D
    good = list(warc.records(archive))
    assert [f["page_id"] for _, f, _ in good] == list(range(5))
    at = good[2][0]
    broken = archive[: at + 9] + bytes([archive[at + 9] ^ 255]) + archive[at + 10 :]
    again = list(warc.records(broken))
    assert [e is None for _, _, e in again].count(False) == 1 and {f["page_id"] for _, f, e in again if e is None} >= {0, 1, 3, 4}
    assert list(warc.records(archive[:-5]))[-1][2] and list(warc.records(b"no"))[0][2]
    with pytest.raises(ValueError):
        warc._parse(records[0].replace(b"Content-Length: ", b"Content-Length: 9"))


def test_fingerprints(spark):
    rng = random.Random(6)
    texts = EDGES + ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 3000))) for _ in range(40)] + ["line of text\n" * 300]
    rows = {r["doc_id"]: r for r in fingerprint.compare_neighbours(docs_of(spark, texts), range_rows=7).collect()}
    assert len(rows) == len(texts)
    order = list(range(len(texts)))[::-1]
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(text) // 3
        new = text[: len(text) - n] + following[:n]
        r, one, two = rows[i], fingerprint.fingerprint(text.encode()), fingerprint.fingerprint(new.encode())
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (one, two)
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(one, two), fingerprint.likeness(one, fingerprint.fingerprint(following.encode())))
    long = [r for i, r in rows.items() if len(texts[i] or "") > 300 and len(EDGES) <= i < len(texts) - 1]
    assert np.mean([r["near_edited"] for r in long]) > 0.5 > 0.1 > np.mean([r["near_next"] for r in long])
    assert fingerprint.compare_neighbours(docs_of(spark, [])).count() == 0


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        assert fingerprint._common(a, b) == slow(a, b)


def slow_fingerprint(raw):
    """Byte by byte, from the description: windows of seven bytes, cuts at multiples of the block size, a letter for each piece."""
    wide = (1 << 64) - 1
    rolled = []
    for i in range(len(raw)):
        h = sum(raw[i - back] * pow(0x01000193, back + 1, 1 << 32) for back in range(min(7, i + 1))) % (1 << 32)
        h ^= h >> 15
        rolled.append((h * 0x2C1B3C6D % (1 << 32)) >> 2)
    k = 0
    while (3 << k) * 128 < len(raw) or sum((h + 1) % (3 << k) == 0 for h in rolled) > 4 * 128:
        k += 1
    out = [str(3 << k)]
    for size in (3 << k, 6 << k, 12 << k):
        letters, piece, place = [], 0, 0
        for i, b in enumerate(raw):
            t = ((b + 1) * 0x9E3779B97F4A7C15 & wide) ^ (place * 0xBF58476D1CE4E5B9 & wide)
            piece = (piece + ((t ^ t >> 29) * 0xBF58476D1CE4E5B9 & wide)) & wide
            place += 1
            if (rolled[i] + 1) % size == 0 or i == len(raw) - 1:
                letters.append("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(piece * 0x9E3779B97F4A7C15 & wide) >> 58])
                piece = place = 0
        out.append("".join(letters))
    return ":".join(out)


def test_fingerprint_byte_by_byte():
    rng = random.Random(12)
    for n in (0, 1, 6, 7, 8, 50, 400, 385, 3000):
        raw = "".join(rng.choice("abcdé \n") for _ in range(n)).encode()
        assert fingerprint.fingerprint(raw) == slow_fingerprint(raw)
    assert fingerprint.fingerprint(b"x" * 900) == slow_fingerprint(b"x" * 900)


def test_signature_spans(monkeypatch):
    text = ("lorem ipsum dolor " * 50 + "x" * 40).encode()
    whole = fingerprint.fingerprint(text)
    monkeypatch.setattr(fingerprint, "SPAN", 64)
    assert fingerprint.fingerprint(text) == whole


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = spark.createDataFrame(stage(spark, out, data).collect(), docs.schema)
        assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert 0 < len(kept) < docs.count()
    _, roots = brute_components([r["text"] for r in out.orderBy("doc_id").collect()])
    assert roots == list(range(len(roots)))  # no near copies are left
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in rows} == kept


def test_texts_are_held_by_the_block():
    """Of a column only one block is turned into objects at a time; every row is met once, in order, and a long text is a block of its own."""
    import tracemalloc

    column = pa.array(["x" * 1000] * 20_000 + [None, "", "y" * 3_000_000, "z"])
    at, found = 0, 0
    tracemalloc.start()
    for start, texts in jaccard._texts(column, 1_000_000):
        size = sum(len(t or b"") for t in texts)
        assert start == at and (size <= 1_000_000 or len(texts) == 1)
        at, found = at + len(texts), found + size
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == len(column) and found == 23_000_001 and peak < 10_000_000
