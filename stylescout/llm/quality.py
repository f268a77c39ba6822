"""Quality rules: word and line statistics of whole texts, and an ordered list of threshold rules learnt from labels.

Everything that touches rows is a DataFrame expression. The learner sees only counts: each labelled document falls in a cell
of a grid (``BINS`` ranges of each of the ``FEATURES``, so the number of cells has a fixed bound), split in a growing and a
pruning half by a hash of its id. Sequential covering: a rule starts empty and takes the threshold condition of highest
information gain until it covers no good document of the growing half; conditions are then dropped from the end while that does not lower the
rule's worth on the pruning half (a rule has at most ``MAX_CONDITIONS`` conditions, the list at most ``MAX_RULES`` rules); the rule is kept if it is precise enough there, what it covers is removed, and the next rule
is grown. The list becomes one chained ``when`` expression.

Defined cases: null and empty texts have no words, fail the base rules and are not kept; a document without words has
rates of 0; without labelled rows, or with one label only, the list is empty and the base rules alone decide; labels of one document
that contradict each other count each; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, durable, stored

WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: name -> expression over the statistics; the rates the rules may test
FEATURES = {
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}
BINS = 7
MAX_RULES = 8
MAX_CONDITIONS = 3
LEAST_PRECISION = 0.9


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep``, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    words = F.filter(F.split(text, f"[{SPACES}]+", -1), lambda x: x != "")
    one = docs.select(
        "doc_id",
        *keep,
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("__lines"),
        F.transform(words, lambda x: F.xxhash64(x)).alias("__words"),
    )
    w, n = F.col("__words"), F.size("__words")
    # each column that a lambda reads is read twice at least, so that it is computed once and not inside the loop
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))
    two = one.select(
        "*",
        n.cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("__win"),
    )
    win = F.col("__win")
    # places of windows that occur twice or more: equal neighbours after sorting by hash
    numbered = F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    three = two.select("*", F.when(F.size(F.array_distinct(win)) < F.size(win), F.array_sort(numbered)).alias("__sorted"))
    s = F.col("__sorted")
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, F.lit(1), F.size(s) - 1))
    after = F.concat(F.slice(s, F.lit(2), F.size(s) - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    twice = F.filter(
        F.arrays_zip(s.alias("x"), before.alias("p"), after.alias("q")),
        lambda z: F.coalesce(z["x"]["h"] == z["p"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["q"]["h"], F.lit(False)),
    )
    four = three.select("*", F.array_sort(F.transform(twice, lambda z: z["x"]["i"])).alias("__at"))
    at = F.col("__at")
    following = F.concat(F.slice(at, F.lit(2), F.size(at) - 1), F.array(F.lit(2_000_000_000)))
    covered = F.aggregate(F.zip_with(at, following, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda x, y: x + y)
    repeated = F.when(F.size(at) > 0, covered).otherwise(0)
    return four.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


@dataclass
class Rule:
    """Reject where all conditions hold: (feature, at_least, threshold)."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_least, cut in self.conditions:
            value = F.expr(FEATURES[name])
            out = out & ((value >= cut) if at_least else (value < cut))
        return out


def _cells(stats: DataFrame, labels: DataFrame) -> tuple[dict[str, list[float]], list[tuple]]:
    """Cut points of each feature and (bins, half, label, count) of the grid's cells: at most BINS ** len(FEATURES) * 4 rows."""
    known = stats.join(labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality"), "doc_id").filter(~base_failed())
    known = durable(known.select("quality", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), *(F.expr(e).alias(f) for f, e in FEATURES.items())))
    # cut points: midpoints of the quantiles of the rarer label and of the other, so that a gap between them is met
    marks = [0.05, 0.25, 0.5, 0.75, 0.95]
    found = known.groupBy("quality").agg(*(F.percentile_approx(f, marks, 2000).alias(f) for f in FEATURES)).collect()
    cuts: dict[str, list[float]] = {}
    for f in FEATURES:
        at = sorted({float(v) for row in found for v in row[f]})
        middle = sorted(((b - a, (a + b) / 2) for a, b in zip(at, at[1:]) if b > a), reverse=True)[: BINS - 1]
        cuts[f] = sorted(m for _, m in middle)
    bins = [sum((F.when(F.col(f) >= c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias(f"b{i}") for i, f in enumerate(FEATURES)]
    cells = known.select("half", "quality", *bins).groupBy("half", "quality", *(f"b{i}" for i in range(len(FEATURES)))).count()
    rows = [(tuple(r[f"b{i}"] for i in range(len(FEATURES))), int(r["half"]), int(r["quality"]), r["count"]) for r in cells.collect()]
    return cuts, rows


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list for documents of label 0, by sequential covering over the grid of counts."""
    cuts, cells = _cells(stats, labels)
    names = list(FEATURES)
    options = [(i, at_least, k) for i, f in enumerate(names) for k in range(len(cuts[f])) for at_least in (True, False)]

    def holds(bins: tuple, condition: tuple) -> bool:
        i, at_least, k = condition
        return (bins[i] > k) == at_least

    def tally(conditions: list[tuple], half: int) -> tuple[int, int]:
        """Bad and good documents that the conditions cover."""
        out = [0, 0]
        for bins, h, label, n in cells:
            if h == half and all(holds(bins, c) for c in conditions):
                out[label != 0] += n
        return out[0], out[1]

    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        grown: list[tuple] = []
        bad, good = tally(grown, 0)
        while good and bad and len(grown) < MAX_CONDITIONS:
            def gain(condition: tuple, grown=grown, bad=bad, good=good) -> float:
                b, g = tally([*grown, condition], 0)
                return b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good))) if b else -1.0

            best = max(options, key=gain, default=None)
            if best is None or gain(best) <= 0:
                break
            grown.append(best)
            bad, good = tally(grown, 0)
        if not grown or not bad:
            break

        def worth(conditions: list[tuple]) -> float:
            b, g = tally(conditions, 1)
            return (b - g) / (b + g) if b + g else -1.0

        while len(grown) > 1 and worth(grown[:-1]) >= worth(grown):
            grown.pop()
        b, g = tally(grown, 1)
        if not b or b < LEAST_PRECISION * (b + g):
            break
        rules.append(Rule([(names[i], at_least, cuts[names[i]][k]) for i, at_least, k in grown]))
        cells = [c for c in cells if not all(holds(c[0], x) for x in grown)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression: the number of the first rule that rejects, null if none does."""
    out = None
    for k, rule in enumerate(rules):
        out = F.when(rule.column(), k) if out is None else out.when(rule.column(), k)
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """statistics() of every row with base_failed, rule (the learnt rule that rejects, if any) and kept."""
    stats = durable(statistics(docs))
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(learn(stats, labels)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rules and the learnt list keep, with their columns."""
    names = docs.columns
    # written once with the rows themselves: the statistics cost more than the copy
    judged = stored(statistics(docs.select("doc_id", "text", F.struct("*").alias("__row")), ("__row",)))
    kept = judged.filter(~base_failed() & verdict(learn(judged, labels)).isNull())
    return kept.select(*(F.col("__row")[c].alias(c) for c in names))
