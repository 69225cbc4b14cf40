"""Quality rules: a learned, ordered decision list over text statistics.

Sequential covering: grow a conjunction of thresholds on the grow rows by information gain, cut it back
on the prune rows, keep it if it is precise, remove what it covers, and go on.  Every count that a
decision needs is one grouped aggregate over all labelled rows, (statistic, bin, label) -> rows, whose
size is fixed by the number of statistics and bins.  The list becomes one ordered ``CASE`` expression.
No Python runs on the executors.

Defined results: a null or empty text has no words and fails the base rule; a null or repeated
``doc_id`` is an ordinary row; a label that is null, or contradicted by another row of the same id, is
not used; without usable labels the list is empty and the base rule alone decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, let, text_or_empty, words_of, written

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RuleConfig:
    bins: int = 24
    max_rules: int = 10
    max_conditions: int = 4
    min_precision: float = 0.95
    min_covered: int = 8
    prune_share: int = 3  # one row in so many is a prune row


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, value: Column) -> Column:
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _repeat_words(w: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, the first occurrence included.

    Window hashes tell which texts can have repeats (equal windows have equal hashes); only those
    sort their window texts, so the count itself rests on the texts.
    """
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)]).alias("s"), i.alias("i"))))

    def repeated(ws: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(ws, j)["s"] == x["s"], F.lit(False))
        hit = F.filter(ws, lambda x, j: same(j - 1, x) | same(j + 1, x))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
        return F.aggregate(at, zero, lambda a, p: F.struct(
            (p + WINDOW).alias("to"), (a["n"] + p + WINDOW - F.greatest(p, a["to"])).alias("n")))["n"]

    has = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    count = let(let(windows, repeated), covered)
    return F.when(F.size(w) <= WINDOW, F.lit(0)).when(has, count).otherwise(F.lit(0))


def _statistics(text: Column) -> Column:
    """A struct of the base counts and the learner's ratios, from one split into words."""

    def of_words(w: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))

        n = F.size(w).cast("long")
        base = F.struct(
            n.alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), of_lines).alias("lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).alias("n_distinct"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_upper"),
            F.regexp_count(text, F.lit(r"[0-9]")).alias("n_digits"),
            F.regexp_count(text, F.lit(r"[!?]")).alias("n_marks"),
        )

        def ratios(b: Column) -> Column:
            def ratio(a, of):
                return F.coalesce(F.try_divide(a.cast("double"), of.cast("double")), F.lit(0.0))

            return F.struct(
                b["n_words"].alias("n_words"), b["word_chars"].alias("word_chars"),
                b["n_symbols"].alias("n_symbols"), b["lines"]["dup"].cast("long").alias("n_dup_lines"),
                b["n_repeat_words"].alias("n_repeat_words"),
                ratio(b["n_symbols"], b["word_chars"]).alias("symbol_share"),
                ratio(b["lines"]["dup"], b["lines"]["n"]).alias("dup_line_share"),
                ratio(b["n_repeat_words"], b["n_words"]).alias("repeat_share"),
                ratio(b["n_distinct"], b["n_words"]).alias("distinct_share"),
                ratio(b["word_chars"], b["n_words"]).alias("mean_word"),
                ratio(b["n_words"], b["lines"]["n"]).alias("mean_line"),
                ratio(b["n_upper"], b["word_chars"]).alias("upper_share"),
                ratio(b["n_digits"], b["word_chars"]).alias("digit_share"),
                ratio(b["n_marks"], b["n_words"]).alias("mark_share"),
            )

        return let(base, ratios)

    return let(words_of(text), of_words)


FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "distinct_share", "mean_word", "mean_line",
            "upper_share", "digit_share", "mark_share", "n_words")


def with_statistics(docs: DataFrame, out: str = "stats", text: str = "text") -> DataFrame:
    """``docs`` plus one struct column of statistics."""
    return docs.withColumn(out, _statistics(text_or_empty(text)))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


# -- learning ------------------------------------------------------------------------------------

def _cuts(train: DataFrame, config: RuleConfig) -> dict[str, list[float]]:
    """Threshold candidates: quantiles of each statistic, over all labelled rows and over the rejected ones."""
    at = [i / config.bins for i in range(1, config.bins)]
    every = train.agg(*[F.percentile_approx(f, at, 5000).alias(f) for f in FEATURES],
                      *[F.percentile_approx(F.when(F.col("bad"), F.col(f)), at, 5000).alias(f"bad_{f}") for f in FEATURES],
                      *[F.percentile_approx(F.when(~F.col("bad"), F.col(f)), [0.0, 0.005, 0.02, 0.98, 0.995, 1.0],
                                            5000).alias(f"good_{f}") for f in FEATURES]).first()
    return {f: sorted({*(every[f] or []), *(every[f"bad_{f}"] or []), *(every[f"good_{f}"] or [])}) for f in FEATURES}


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of ``cuts`` lie below the value: bin b holds cuts[b-1] < value <= cuts[b]."""
    return reduce(lambda a, b: a + b, [(value > F.lit(c)).cast("int") for c in cuts], F.lit(0))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn_rules(labelled: DataFrame, config: RuleConfig = RuleConfig()) -> list[list[Condition]]:
    """Ordered rules, each a conjunction; a row that meets all conditions of any rule is rejected.

    ``labelled``: doc_id, bad boolean, and the columns of FEATURES.
    """
    split = F.pmod(F.xxhash64("doc_id"), F.lit(config.prune_share)) == 0
    train = written(labelled.select("bad", split.alias("prune"), *[F.col(f).cast("double").alias(f) for f in FEATURES]),
                    "quality-train")
    totals = train.agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
    if not totals["p"] or not totals["n"]:
        return []
    cuts = {f: c for f, c in _cuts(train, config).items() if c}
    binned = written(train.select("bad", "prune", *[_bin(F.col(f), c).alias(f) for f, c in cuts.items()])
                     .groupBy("bad", "prune", *cuts).agg(F.count("*").alias("rows")), "quality-bins")

    def cond(c: Condition) -> Column:  # on bins
        at = cuts[c.feature].index(c.threshold) + 1
        return F.col(c.feature) >= at if c.above else F.col(c.feature) < at

    def both(rule: list[Condition]) -> Column:
        return reduce(lambda a, b: a & b, [cond(c) for c in rule], F.lit(True))

    def counts(rows: DataFrame) -> dict[tuple[str, int, bool], int]:
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in cuts]))
        got = rows.select("bad", "rows", cells.alias("c")).groupBy("c.f", "c.b", "bad").agg(F.sum("rows").alias("rows"))
        return {(r["f"], r["b"], r["bad"]): r["rows"] for r in got.collect()}  # at most statistics x bins x 2

    rules: list[list[Condition]] = []
    left = binned
    while len(rules) < config.max_rules:
        rule: list[Condition] = []
        while len(rule) < config.max_conditions:
            cell = counts(left.where(~F.col("prune") & both(rule)))
            first = next(iter(cuts))
            p0 = sum(v for (f, _, bad), v in cell.items() if f == first and bad)
            n0 = sum(v for (f, _, bad), v in cell.items() if f == first and not bad)
            if not p0 or not n0:
                break
            best: tuple[float, Condition] | None = None
            for f, own in cuts.items():
                p = n = 0
                for b, threshold in enumerate(own):
                    p += cell.get((f, b, True), 0)
                    n += cell.get((f, b, False), 0)
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        if pp >= config.min_covered // 2 and (nn < n0) and (g := _gain(pp, nn, p0, n0)) > 1e-9 and (
                                best is None or g > best[0]):
                            best = (g, Condition(f, above, threshold))
            if best is None:
                break
            rule.append(best[1])
        if not rule:
            break
        row = left.agg(*[F.sum(F.when(both(rule[:k]) & side & label, F.col("rows")).otherwise(0)).alias(f"{k}{s}{v}")
                         for k in range(1, len(rule) + 1) for s, side in (("g", ~F.col("prune")), ("p", F.col("prune")))
                         for v, label in (("p", F.col("bad")), ("n", ~F.col("bad")))]).first()
        worth = [((row[f"{k}pp"] - row[f"{k}pn"]) / max(1, row[f"{k}pp"] + row[f"{k}pn"]), -k) for k in range(1, len(rule) + 1)]
        k = -max(worth)[1]
        rule, p, n = rule[:k], row[f"{k}gp"] + row[f"{k}pp"], row[f"{k}gn"] + row[f"{k}pn"]
        if p < config.min_covered or (p + 1) / (p + n + 2) < config.min_precision:
            break
        rules.append(rule)
        left = left.where(~both(rule))
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, config: RuleConfig = RuleConfig(),
              stats: str | None = None) -> list[list[Condition]]:
    """Learn from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) covers.

    ``stats`` names a column of ready statistics in ``docs``.
    """
    known = (labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
             .select("doc_id", (F.col("q") == 0).alias("bad")))
    if stats is None:
        docs, stats = with_statistics(docs.select("doc_id", "text").join(known.select("doc_id"), "doc_id", "left_semi"),
                                      "stats"), "stats"
    rows = docs.select("doc_id", *[F.col(f"{stats}.{f}").alias(f) for f in FEATURES]).join(known, "doc_id")
    return learn_rules(rows, config)


def verdict(s: Column, rules: list[list[Condition]]) -> Column:
    """The ordered conditional expression: false at the base rule or the first rule that holds, else true."""
    case = F.when(base_failed(s), F.lit(False))
    for rule in rules:
        case = case.when(reduce(lambda a, b: a & b, [c.column(s[c.feature]) for c in rule]), F.lit(False))
    return case.otherwise(F.lit(True))


def describe(rules: list[list[Condition]]) -> list[str]:
    return [" and ".join(map(str, r)) for r in rules]


def score_quality(docs: DataFrame, labels: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """doc_id, the base counts, base_failed and kept, one row per row of ``docs``."""
    rows = written(with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats"), "quality-stats")
    rules = fit_rules(rows, labels, config, "stats")
    s = F.col("stats")
    return rows.select("doc_id", *[s[c].alias(c) for c in BASE], base_failed(s).alias("base_failed"),
                       verdict(s, rules).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """The rows of ``docs`` that the base rule and the list keep, with their columns as they are."""
    s = fresh(docs.columns, "stats")
    # each text is read and judged once, and the labels meet the statistics, not the texts
    rows = written(with_statistics(docs, s), "quality-rows")
    rules = fit_rules(rows, labels, config, s)
    return rows.where(verdict(F.col(s), rules)).select(*docs.columns)
