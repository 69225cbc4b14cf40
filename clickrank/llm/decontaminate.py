"""Benchmark decontamination: normalised test n-grams as a hash set, scanned over every training token.

The n-grams of the benchmark form two broadcast sets, both bounded by the benchmark's words: the seeds
(hashes of m-word pieces of the windows) and the windows themselves.  A text is scanned at every ``step``-th
word only, m = ceil(shortest window / 2) and step = shortest - m + 1: any window inside the text holds an
aligned m-word piece, so no hit is lost.  What is scanned is hashes alone; of the texts with a hashed hit, the words
around the hit pieces are fetched, and an equi-join on the window text verifies each hit.  No Python runs on the
executors.

Defined results: a null or empty text has no words, no hits and is not contaminated; benchmark items that
are null, empty or without words have no window; repeated items count per item_id; an item without an id is
matched for hits but is not counted among the items; equal rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keys, let, lower_ascii, merged_runs, row_key, text_or_empty, words_of, written

#: Letters, digits and everything beyond ASCII: the complement of [\x00-\x2F\x3A-\x60\x7B-\x7F], spelled out
#: because Java matches a short positive class several times faster than a negated one.
TOKEN = r"[a-z0-9\x{80}-\x{10FFFF}]+"
#: The same tokens before A-Z are lower-cased.
RAW_TOKEN = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]+"
WINDOW = 13
#: Words in the benchmark's windows up to which both sets are broadcast; beyond it the same joins shuffle.
MAX_BROADCAST_WORDS = 5_000_000


def tokens(text: str = "text") -> Column:
    return words_of(lower_ascii(text_or_empty(text)), TOKEN)


def count_tokens() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(RAW_TOKEN)).cast("long")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, gram, w): every window of every item; shorter items are one window of all their words."""
    items = benchmark.select("item_id", tokens().alias("t")).where(F.size("t") > 0)
    n = F.least(F.lit(window), F.size("t"))
    at = items.select("item_id", "t", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("t") - n)).alias("i"))
    return at.select("item_id", "n", F.slice("t", F.col("i") + 1, F.col("n")).alias("w")).distinct() \
        .withColumn("gram", F.array_join("w", " "))


def _piece(w: Column, at: Column, m: int) -> Column:
    return F.xxhash64(*[F.get(w, at + k) for k in range(m)])


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, at, n, item_id): each occurrence of a benchmark window in a text; key is common.row_key."""
    spark = docs.sparkSession
    grams = written(benchmark_windows(benchmark, window), "benchmark-windows")
    sizes = grams.agg(F.min("n").alias("least"), F.collect_set("n").alias("all"), F.sum("n").alias("words")).first()
    if sizes["least"] is None:
        return spark.createDataFrame([], "key string, at int, n int, item_id long")
    least = sizes["least"]
    m = (least + 1) // 2
    step = least - m + 1
    seeds = written(grams.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - m),
                                                       lambda i: _piece(F.col("w"), i, m))).alias("h")).distinct(),
                    "benchmark-seeds")
    most = max(sizes["all"])
    reach = most - m  # words before a piece that a window around it can take in

    def pieces(w: Column) -> Column:
        """Where each scanned piece starts, and its hash."""
        at = F.when(F.size(w) >= m, F.sequence(F.lit(0), F.size(w) - m, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("i"), _piece(w, i, m).alias("h")))

    if sizes["words"] <= MAX_BROADCAST_WORDS:
        seeds = F.broadcast(seeds)
    scanned = docs.select(row_key().alias("key"), F.explode(let(tokens(), pieces)).alias("p")).select("key", "p.*")
    hit = written(scanned.join(seeds, "h", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("i")).alias("at")), "benchmark-seen")
    texts = docs.select(row_key().alias("key"), "text").join(keys(hit.select("key"), "benchmark-hit-keys"), "key", "left_semi")

    def around(w: Column) -> Column:
        """Of each hit piece: where it starts, the words that windows around it can cover, and where in these it is."""
        return F.transform(F.col("at"), lambda i: F.struct(
            i.alias("i"), F.least(i, F.lit(reach)).alias("lead"),
            F.slice(w, F.greatest(F.lit(0), i - reach) + 1, F.least(i, F.lit(reach)) + most).alias("near")))

    seen = texts.join(hit, "key").select("key", F.explode(let(tokens(), around)).alias("p")).select("key", "p.*")

    def windows(n: int) -> Column:
        """The n-word windows within ``near`` that hold the piece, which starts at its word ``lead``."""
        first, last = F.greatest(F.lit(0), F.col("lead") - (n - m)), F.least(F.col("lead"), F.size("near") - n)
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda j: F.struct(
            (F.col("i") - F.col("lead") + j).alias("at"), F.lit(n).alias("n"),
            F.array_join(F.slice("near", j + 1, n), " ").alias("gram"))))

    none = F.array().cast("array<struct<at:int,n:int,gram:string>>")
    tried = seen.select("key", F.explode(F.concat(*[F.coalesce(windows(n), none) for n in sorted(sizes["all"])])).alias("x")) \
        .select("key", "x.*")
    known = grams.select("item_id", "n", "gram")
    if sizes["words"] <= MAX_BROADCAST_WORDS:
        known = F.broadcast(known)
    return written(tried.join(known, ["n", "gram"]).select("key", "at", "n", "item_id"), "benchmark-found")


def _per_text(hits: DataFrame) -> DataFrame:
    """(key, n_hit, n_items, items_sha256): per text, over at most its own words and the benchmark's items."""
    items = hits.where("item_id is not null").select("key", F.col("item_id").cast("string").alias("item")).distinct() \
        .groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    spans = hits.select("key", "at", "n").distinct().groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("at", "n"))).alias("at"))
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    covered = F.aggregate("at", zero, lambda a, p: F.struct(
        F.greatest(a["to"], p["at"] + p["n"]).alias("to"),
        (a["n"] + F.greatest(F.lit(0), p["at"] + p["n"] - F.greatest(a["to"], p["at"]))).alias("n")))["n"]
    return spans.join(items, "key", "left").select(
        "key", covered.cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), F.col("at").alias("spans"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def score_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``."""
    hits = written(_per_text(find_hits(docs, benchmark, window)), "benchmark-hits")
    rows = docs.select(row_key().alias("key"), "doc_id", count_tokens().alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(hits, "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose hits stay below the contamination rule, with their columns as they are."""
    hits = written(_per_text(find_hits(docs, benchmark, window)).select("key", "n_hit"), "benchmark-hits")
    key, hit = fresh(docs.columns, "row_key"), fresh(docs.columns, "n_hit")
    out = docs.withColumn(key, row_key()).join(hits.select(F.col("key").alias(key), F.col("n_hit").alias(hit)), key, "left")
    return out.where(F.col(hit).isNull() | ~contaminated(F.col(hit), count_tokens())).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every hit word and what stands between two hit words taken out of ``text``.

    The text around the removed runs is kept as it is; hit texts are rebuilt from the pieces between tokens.
    """
    hits = find_hits(docs, benchmark, window).select("key", "at", (F.col("at") + F.col("n")).alias("to")).distinct()
    hits = written(merged_runs(hits, "key", "at", "to"), "benchmark-runs")
    key, runs = fresh(docs.columns, "row_key"), fresh(docs.columns, "runs")
    out = docs.withColumn(key, row_key()).join(hits.select(F.col("key").alias(key), F.col("runs").alias(runs)), key, "left")
    # gaps and words in turn, a gap first: the words of a run [start, end) and the gaps after them are the places from
    # 2 start + 1 to 2 end, counted from 0; what stands between the runs is cut out as slices
    gaps, words = F.split("text", RAW_TOKEN, -1), words_of(F.col("text"), RAW_TOKEN)
    flat = let(words, lambda w: F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.get(w, i)))))

    def kept(parts: Column) -> Column:
        def piece(i: Column) -> Column:
            start = F.when(i > 0, 2 * F.get(F.col(runs), i - 1)["end"] + 1).otherwise(F.lit(0))
            end = F.when(i < F.size(runs), 2 * F.get(F.col(runs), i)["start"] + 1).otherwise(F.size(parts))
            return F.slice(parts, start + 1, end - start)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), piece)), "")

    return out.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(let(flat, kept))).select(*docs.columns)
