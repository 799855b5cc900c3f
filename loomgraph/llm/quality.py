"""Quality rules: text statistics as Spark expressions, and a learned decision list.

Sequential covering learns, from a bounded sample of labelled statistics,
an ordered list of threshold conjunctions that mark bad documents.  A rule is
grown test by test on one part of the sample and pruned on the other; it is
taken only if it is precise enough on the second.  The list is emitted as one
ordered Spark conditional expression.

Defined results: null text has no words; texts of any length are read whole;
labels of repeated ids count once per row; without labels, or with one class
only, the list is empty and only the base rules reject; further columns are
kept by ``keep_good`` and ignored by ``statistics``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, text_or_empty, unused_prefix

#: At most so many labelled rows are brought to the driver to learn from.
MAX_LABELLED_ROWS = 20_000
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Names of the features that rules may test, in per-word or per-character shares.
FEATURES = ("n_words", "word_length", "symbol_share", "exclaim_share", "upper_share", "dup_line_share", "repeat_share", "distinct_share")


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs`` plus a struct of whole-text statistics, and its name."""
    q = unused_prefix(docs, "_q")
    text = F.col(f"{q}text")
    split = docs.withColumn(f"{q}text", text_or_empty(text_col)).withColumn(f"{q}words", F.filter(F.split(text, SPACE, -1), lambda w: w != ""))
    words, grams, lines, ranked = (F.col(f"{q}{x}") for x in ("words", "grams", "lines", "ranked"))
    windows = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    split = split.withColumn(f"{q}grams", F.slice(windows, 1, F.greatest(F.size(words) - 2, F.lit(0))))
    split = split.withColumn(f"{q}lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    in_order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    split = split.withColumn(f"{q}ranked", F.when(F.size(F.array_distinct(grams)) < F.size(grams), in_order))
    same = lambda x, k: F.coalesce(F.get(ranked, k)["g"] == x["g"], F.lit(False))
    twice = F.filter(ranked, lambda x, k: same(x, k - 1) | same(x, k + 1))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")),
    )["n"]
    less = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    stats = F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.char_length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        less(SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        less("!").cast("bigint").alias("n_exclaim"),
        less(UPPER).cast("bigint").alias("n_upper"),
        F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
        F.size(lines).cast("bigint").alias("n_lines"),
    )
    # exploding one struct keeps filters on it above: pushed down, they would be
    # copied into the lambdas and evaluate whole arrays for every element
    out = split.select("*", F.explode(F.array(stats)).alias(f"{q}stats"))
    return out.drop(*[f"{q}{x}" for x in ("text", "words", "grams", "lines", "ranked")]), f"{q}stats"


def features(stats: str) -> dict[str, Column]:
    """Feature expressions over the statistics; shares of nothing are 0."""
    s = lambda k: F.col(f"{stats}.{k}").cast("double")
    share = lambda a, b: F.when(s(b) > 0, s(a) / s(b)).otherwise(F.lit(0.0))
    return {
        "n_words": s("n_words"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"),
        "exclaim_share": share("n_exclaim", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
    }


def base_failed(stats: str) -> Column:
    """Too few words, or over half of them in repeated three-word windows."""
    n = F.col(f"{stats}.n_words")
    return (n < 50) | (100 * F.col(f"{stats}.n_repeat_words") > 50 * n)


@dataclass(frozen=True)
class Test:
    """One threshold: feature >= value, or feature <= value."""

    feature: int
    at_least: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] >= self.value if self.at_least else x[:, self.feature] <= self.value

    def column(self, named: dict[str, Column]) -> Column:
        c = named[FEATURES[self.feature]]
        return c >= self.value if self.at_least else c <= self.value

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.at_least else '<='} {self.value:.6g}"


def _covers(rule: list[Test], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _precision(rule: list[Test], x: np.ndarray, bad: np.ndarray) -> float:
    c = _covers(rule, x)
    return (bad[c].sum() + 1.0) / (c.sum() + 2.0)


def _best_test(x: np.ndarray, bad: np.ndarray, n_cuts: int) -> tuple[float, Test | None]:
    """The test of largest FOIL gain: bad rows kept times the gain in information.

    A threshold lies halfway to the next value on the other side; of equal
    gains the widest gap, as a share of the feature's range, wins.
    """
    p0 = bad.sum()
    base = np.log2((p0 + 1) / (len(bad) + 2))
    best, chosen = (0.0, 0.0), None
    for f in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_cuts), method="nearest"))
        order = np.argsort(x[:, f], kind="stable")
        ranked, hits = x[order, f], np.concatenate(([0], np.cumsum(bad[order])))
        reach = max(ranked[-1] - ranked[0], 1e-12)
        for v in values:
            lo, hi = np.searchsorted(ranked, v, "left"), np.searchsorted(ranked, v, "right")
            for at_least, n, p in ((True, len(bad) - lo, p0 - hits[lo]), (False, hi, hits[hi])):
                if p and n < len(bad):
                    other = ranked[lo - 1] if at_least else ranked[hi]
                    score = (round(p * (np.log2((p + 1) / (n + 2)) - base), 9), abs(v - other) / reach)
                    if score[0] > 0 and score > best:
                        best, chosen = score, Test(f, at_least, float((v + other) / 2))
    return best[0], chosen


def learn(x: np.ndarray, bad: np.ndarray, least_precision: float = 0.75, least_rows: int = 4, max_rules: int = 12, max_tests: int = 4, n_cuts: int = 129) -> list[list[Test]]:
    """Sequential covering; every third row (in order) prunes, the others grow."""
    prune = np.arange(len(x)) % 3 == 2
    gx, gb, px, pb = x[~prune], bad[~prune], x[prune], bad[prune]
    rules: list[list[Test]] = []
    while gb.sum() >= least_rows and len(rules) < max_rules:
        rule: list[Test] = []
        rx, rb = gx, gb
        while len(rule) < max_tests and len(rb) and not rb.all():
            _, test = _best_test(rx, rb, n_cuts)
            if test is None:
                break
            keep = test.holds(rx)
            rule, rx, rb = [*rule, test], rx[keep], rb[keep]
        while len(rule) > 1:
            shorter = max(([t for t in rule if t is not u] for u in rule), key=lambda r: _precision(r, px, pb))
            if _precision(shorter, px, pb) < _precision(rule, px, pb):
                break
            rule = shorter
        got = _covers(rule, gx) if rule else np.zeros(len(gx), bool)
        seen = _covers(rule, px)
        if not rule or not got.any() or _precision(rule, px, pb) < least_precision or pb[seen].sum() < 2:
            break
        rules.append(rule)
        gx, gb = gx[~got], gb[~got]
        px, pb = px[~seen], pb[~seen]
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_LABELLED_ROWS, **options) -> list[list[Test]]:
    """Learn from at most ``max_rows`` labelled rows, chosen by a hash of the id."""
    chosen = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).where("id is not null and label is not null")
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows, stats = statistics(id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "id"))
    named = features(stats)
    rows = rows.where(~base_failed(stats)).select("id", "label", *[named[k].alias(k) for k in FEATURES]).collect()
    rows.sort(key=lambda r: tuple(float(v) for v in r[2:]) + (r[0],))
    x = np.array([[float(r[k]) for k in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r["label"] == 0 for r in rows], bool), **options)


def rejected(rules: list[list[Test]], stats: str) -> Column:
    """The decision list as one ordered conditional expression."""
    named, out = features(stats), None
    for rule in rules:
        every = rule[0].column(named)
        for t in rule[1:]:
            every = every & t.column(named)
        out = F.when(every, True) if out is None else out.when(every, True)
    return F.lit(False) if out is None else out.otherwise(False)


def judge(docs: DataFrame, rules: list[list[Test]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every document."""
    s, stats = statistics(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    shown = [F.col(f"{stats}.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = base_failed(stats)
    return s.select(F.col("id").alias(id_col), *shown, failed.alias("base_failed"), (~failed & ~rejected(rules, stats)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[list[Test]], text_col: str = "text") -> DataFrame:
    """Rows that neither the base rules nor the list rejects, all columns kept."""
    kept, stats = statistics(docs, text_col)
    return kept.where(~base_failed(stats) & ~rejected(rules, stats)).drop(stats)
