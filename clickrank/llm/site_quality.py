"""Quality classifier: document evidence shrunk through a site hierarchy by empirical Bayes.

Two labels, toxic and quality, are treated alike:

1. Words.  Document frequencies of hashed words, word beginnings and word shapes by label and fold, summed over one row
   of each different labelled text.  Each word's log-odds for the rarer label are shrunk by empirical Bayes: the shares
   of all words at each step of a grid of odds are the prior (fitted by EM), and a word weighs its posterior mean if it
   is telling with a probability of ``certainty``; so few labels give few words, and many labels give more.
2. Evidence.  A text's evidence is the sum of the weights of its distinct words; a labelled text's comes from the
   weights of the other folds.  The labelled rows' histogram of evidence by label, made monotone, turns it into a
   likelihood ratio, so that scores are calibrated out of fold with all labels.
3. Sites.  Label counts per host and per path, by grouped aggregates.  A host's rate is shrunk towards the
   global rate and a path's towards its host's, with prior strengths from the spread of the rates (moments).
4. Posterior odds of a document = the odds of its path's rate times its likelihood ratio.

The model is ``buckets`` weights per label and fold and ``bins`` ratios, whatever the corpus; sites are joined, never collected.

Defined results: null and empty texts have no words, hence the ratio of that evidence; null hosts and paths
are sites of their own; rows with a null id are scored but not learned from; a label that is null, or
contradicted by another row of the same id, isn't used; equal texts are learned from once for each pair of labels and
fall into one fold; ties of evidence share a ratio; without labels every rate is one half; an empty table gives no rows;
very long texts are read whole; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keys, text_or_empty, written

LABELS = ("toxic", "quality")
#: Stripped from word ends before hashing.
MARKS = ".,;:!?\"'()[]"
#: Lengths of the word beginnings that count as features.
STEMS = (5, 7)
SHAPES = (("a", re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")), ("A", re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de]+")),
          ("0", re.compile("[0-9]+")))
#: Steps of log-odds that a word can have for the rarer label, beside the label's own share.
STEPS = np.arange(-3, 8.5, 0.5)


@dataclass(frozen=True)
class SiteConfig:
    buckets: int = 1 << 18
    folds: int = 4
    min_odds: float = 2.5  # weaker words weigh nothing: a long clean text would gather many of them
    certainty: float = 0.99  # posterior probability of such odds that a word needs to weigh anything
    min_support: float = 0.02  # a word must stand in this share of the rarer label's rows: near copies are no evidence
    min_rows: int = 3  # and in so many of them
    em_rounds: int = 60
    bins: int = 41
    bin_width: float = 1.0
    max_strength: float = 10_000.0


def _shape(word: str) -> str:
    """A word with runs of small letters, capitals and digits as a, A and 0; its marks stay."""
    for kind, run in SHAPES:
        word = run.sub(kind, word)
    return word[:12]


def _word_sets(texts: list[str | None], buckets: int) -> Iterator[np.ndarray]:
    h = xxhash.xxh32_intdigest
    for t in texts:
        words = (t or "").split()
        raw = set(words)
        # a word as it stands (its marks and case tell of quality), its bare form, its beginnings and its shape
        bare = {w.strip(MARKS).lower() for w in raw}
        seen = {h(w) % buckets for w in raw} | {h(w, 1) % buckets for w in bare}
        for n in STEMS:
            seen.update({h(w, n) % buckets for w in {w[:n] for w in bare if len(w) > n}})
        seen.update({h(w, 2) % buckets for w in set(map(_shape, raw))})
        if any(map(str.__eq__, words, words[1:])):
            seen.add(h("twice", 3) % buckets)
            if any(a == b == c for a, b, c in zip(words, words[1:], words[2:])):
                seen.add(h("thrice", 3) % buckets)
        yield np.fromiter(seen, np.int64, len(seen))


def _site_columns(host: str | Column, path: str | Column) -> list[Column]:
    host, path = (F.col(c) if isinstance(c, str) else c for c in (host, path))
    return [F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path")]


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, quality) of ids whose labels don't contradict each other; null where a label is unusable."""
    ok = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).cast("int").alias(c)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(*[ok(c) for c in LABELS])


def word_weights(rows: tuple[float, float], with_word: np.ndarray, config: SiteConfig) -> np.ndarray:
    """The weight of each word for the rarer label, from the rows of labels 0 and 1 and those with the word (2 x words).

    The words' odds are drawn from one unknown distribution over STEPS, fitted to all words by EM; it is the prior of each.
    """
    if not all(rows) or not with_word.shape[1]:
        return np.zeros(with_word.shape[1])
    rare = int(rows[1] < rows[0])
    # many words share their counts: each pair of counts is worked out once
    pairs, word, times = np.unique(with_word[rare] * (int(rows[1 - rare]) + 1) + with_word[1 - rare], return_inverse=True, return_counts=True)
    hits, others = (x.astype(float) for x in np.divmod(pairs, int(rows[1 - rare]) + 1))
    shifted = np.log(rows[rare] / rows[1 - rare]) + STEPS
    like = -hits[:, None] * np.log1p(np.exp(-shifted)) - others[:, None] * np.log1p(np.exp(shifted))
    like = np.exp(like - like.max(axis=1, keepdims=True))
    prior = np.where(STEPS == 0, 1.0, 1e-3)
    prior /= prior.sum()
    times = times * (hits + others > 0)
    for _ in range(config.em_rounds if times.any() else 0):
        post = like * prior
        prior = times @ (post / post.sum(axis=1, keepdims=True)) / times.sum()
    post = like * prior
    post /= post.sum(axis=1, keepdims=True)
    telling = STEPS >= config.min_odds
    sure = post[:, telling].sum(axis=1) >= config.certainty
    sure &= hits >= max(config.min_rows, config.min_support * rows[rare])
    return np.where(sure, post @ np.where(telling, STEPS, 0), 0)[word]


def learn_words(labelled: DataFrame, config: SiteConfig) -> np.ndarray:
    """weights[fold, label, bucket] from (text, fold, toxic, quality): learned without that fold; the last, from all rows."""
    kinds = 2 * len(LABELS)

    def run(batches):
        total = np.zeros((config.folds * kinds, config.buckets), np.int64)
        rows = np.zeros(config.folds * kinds, np.int64)
        for b in batches:
            marks = [b.column(c).to_pylist() for c in LABELS]
            for i, (fold, words) in enumerate(zip(b.column("fold").to_pylist(), _word_sets(b.column("text").to_pylist(), config.buckets))):
                for k, m in enumerate(marks):
                    if m[i] is not None:
                        total[fold * kinds + 2 * k + (m[i] != 0), words] += 1
                        rows[fold * kinds + 2 * k + (m[i] != 0)] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), *[pa.array(np.append(n[at], r)) for n, r in zip(total, rows)]], ["bucket", *cols])

    cols = [f"n{j}" for j in range(config.folds * kinds)]
    sums = labelled.select("text", "fold", *LABELS).mapInArrow(run, ", ".join(["bucket long", *[f"{c} long" for c in cols]])) \
        .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()  # at most buckets + 1 rows
    counts = np.zeros((config.folds * kinds, config.buckets + 1), np.int64)  # the last is bucket -1
    for n, c in zip(counts, cols):
        n[sums["bucket"].to_numpy()] = sums[c].to_numpy()
    del sums
    counts = counts.reshape(config.folds, len(LABELS), 2, -1)
    weights = np.zeros((config.folds + 1, len(LABELS), config.buckets), np.float32)
    for fold in range(config.folds + 1):
        got = counts.sum(axis=0) - (counts[fold] if fold < config.folds else 0)
        for k in range(len(LABELS)):
            at = np.flatnonzero(got[k, :, :-1].sum(axis=0))
            weights[fold, k, at] = word_weights(tuple(got[k, :, -1].astype(float)), got[k][:, at], config)
    return weights


def with_evidence(docs: DataFrame, weights: np.ndarray, config: SiteConfig, *columns: str) -> DataFrame:
    """``columns`` plus the bin of each label's evidence, by the weights of the row's ``fold`` (null: of all rows)."""
    def run(batches):
        for b in batches:
            folds = [config.folds if f is None else f for f in b.column("fold").to_pylist()]
            sums = [weights[f][:, w].sum(axis=1) for f, w in zip(folds, _word_sets(b.column("text").to_pylist(), config.buckets))]
            bins = np.minimum(np.rint(np.array(sums, float).reshape(-1, len(LABELS)) / config.bin_width), config.bins - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *[pa.array(bins[:, k]) for k in range(len(LABELS))]],
                                             [*columns, *[f"bin_{c}" for c in LABELS]])

    types = dict(docs.dtypes)
    return docs.select(*columns, "fold", "text").mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in columns],
                                                                    *[f"bin_{c} long" for c in LABELS]]))


def _ratios(labelled: DataFrame, config: SiteConfig) -> dict[str, list[float]]:
    """log likelihood ratio of label 1 for each evidence bin.

    The share of the rarer label may only rise with the evidence for it: neighbouring bins that fall are pooled.
    """
    out = {}
    for c in LABELS:
        got = labelled.where(F.col(c).isNotNull()).groupBy(f"bin_{c}", c).count().collect()  # bins x 2
        n = np.zeros((2, config.bins))
        for r in got:
            n[int(r[c] != 0), r[f"bin_{c}"]] += r["count"]
        if not n.sum(axis=1).all():
            out[c] = [0.0] * config.bins
            continue
        rare = int(n[1].sum() < n[0].sum())
        base = n[rare].sum() / n.sum()
        pools: list[list[float]] = []  # rarer rows, rows, bins
        for hit, all_ in zip(n[rare], n.sum(axis=0)):
            pools.append([hit + base, all_ + 1, 1])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last)]
        rate = np.concatenate([np.full(int(k), h / m) for h, m, k in pools])
        ratio = np.log(rate / (1 - rate)) - np.log(base / (1 - base))
        out[c] = [float(x) for x in (ratio if rare else -ratio)]
    return out


def _strength(rates: DataFrame, mean: float, limit: float) -> float:
    """Prior rows that the spread of the groups' rates asks for (method of moments on n-weighted variance)."""
    r = rates.agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - mean, 2)).alias("s"),
                  F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    if not r["n"] or r["g"] < 2 or mean in (0.0, 1.0):
        return limit
    var = mean * (1 - mean)
    between = (r["s"] - (r["g"] - 1) * var) / max(1e-9, r["n"] - r["nn"] / r["n"])
    return limit if between <= 0 else float(min(limit, max(1.0, var / between - 1)))


def site_rates(labelled: DataFrame, label: str, config: SiteConfig) -> tuple[DataFrame, DataFrame, float]:
    """(hosts, paths, global rate): host, rate / host, path, rate, shrunk towards the level above."""
    rows = labelled.where(F.col(label).isNotNull())
    paths = written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum((F.col(label) != 0).cast("long")).alias("k")),
                    "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (total["k"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    s = _strength(hosts, mean, config.max_strength)
    hosts = written(hosts.select("host", ((F.col("k") + s * mean) / (F.col("n") + s)).alias("host_rate")), "site-hosts")
    s = _strength(paths, mean, config.max_strength)
    paths = paths.join(hosts, "host").select("host", "path", ((F.col("k") + s * F.col("host_rate")) / (F.col("n") + s)).alias("path_rate"))
    return hosts, written(paths, "site-path-rates"), mean


def classify(docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column = "lang",
             config: SiteConfig = SiteConfig()) -> DataFrame:
    """doc_id, p_toxic, p_quality, toxic, kept: one row per row of ``docs``."""
    rows = docs.select("doc_id", text_or_empty().alias("text"), *_site_columns(host, path))
    known = keys(known_labels(labels), "site-labels")
    fold = F.pmod(F.xxhash64("text"), F.lit(config.folds)).alias("fold")
    # one row of each different labelled text is learned from; only its id moves
    marks = rows.join(known, "doc_id").select("doc_id", "host", "path", fold, *[F.xxhash64(F.lit(k), "text").alias(f"k{k}") for k in (1, 2)], *LABELS)
    one = marks.groupBy("fold", "k1", "k2", *LABELS).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fold", *LABELS).distinct()
    some = rows.join(keys(one.withColumnRenamed("fold", "own"), "site-texts"), "doc_id").select("text", fold, "own", *LABELS)
    weights = learn_words(some.where("fold = own"), config)
    judged = rows.join(known.select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left") \
        .withColumn("fold", F.when(F.col("labelled"), fold))
    scored = written(with_evidence(judged, weights, config, "doc_id", "host", "path"), "site-evidence")
    ratios = _ratios(scored.join(known, "doc_id"), config)
    out = scored
    for c in LABELS:
        hosts, paths, mean = site_rates(marks, c, config)
        out = out.join(keys(hosts, "site-h"), "host", "left").join(keys(paths, "site-p"), ["host", "path"], "left")
        rate = F.coalesce("path_rate", "host_rate", F.lit(mean))
        ratio = F.get(F.array(*map(F.lit, ratios[c])), F.col(f"bin_{c}").cast("int"))
        odds = F.log(rate) - F.log(1 - rate) + ratio
        out = out.withColumn(f"p_{c}", 1 / (1 + F.exp(-odds))).drop("host_rate", "path_rate")
    toxic = F.col("p_toxic") >= 0.5
    return out.select("doc_id", F.round("p_toxic", 6).alias("p_toxic"), F.round("p_quality", 6).alias("p_quality"),
                      toxic.alias("toxic"), (~toxic & (F.col("p_quality") >= 0.5)).alias("kept"))
