"""License scans: sparse TF-IDF cosine of passages to notices and licence bodies, then inheritance from the nearest
ancestor directory.

1. Every word gets its inverse document frequency from all lines: one grouped count of (line, word), of which the
   templates' words come to the driver and the candidate texts' are joined.
2. For each template some words are indispensable: the others together are too light to reach the threshold.
   Texts and lines without any such word can't match, so only those with one are scored (no match is lost).
3. Three kinds of passage are scored against the notices and the bodies: each line, the whole text, and every run of as
   many words as the template has, wherever lines end.  Lines and texts meet the templates in an equi-join on the word.
   The runs are scored exactly by running sums: a word enters at its position and leaves a template's length later,
   and changes the product, its count and so the norm.  Texts whose words can't reach the threshold are left out.
4. A text with a match carries that licence.  If the whole text matches, or matched lines hold at least half of its
   words, it is a licence file, which speaks for its directory.  A text without a match takes the licence of the
   nearest ancestor directory that has one, by joining its ancestors to the directories.  No Python runs on the
   executors.

Defined results: null and empty texts match nothing, but inherit; null path parts are empty names; of several
licences the whole text's wins, then a body's, then a notice's, of these the best cosine, ties by name; in a directory
with several files the best cosine; equal rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from importlib.resources import files

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keys, lower_ascii, row_key, text_or_empty, words_of, written
from .decontaminate import TOKEN, count_tokens

#: Short notices by SPDX identifier.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Licence bodies, files of this package.
BODY_FILES = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0",
              "MIT", "MPL-2.0", "Unlicense")
#: Bodies made from a sister's by replacing its name, so that such files aren't taken for the sister's.
DERIVED = (("AGPL-3.0", "GPL-3.0", (("GNU General", "GNU Affero General"), ("GNU GENERAL", "GNU AFFERO GENERAL"))),
           ("CC-BY-4.0", "CC-BY-SA-4.0", (("Attribution-ShareAlike", "Attribution"), ("ShareAlike", ""), ("BY-SA", "BY"))),
           ("CC-BY-NC-4.0", "CC-BY-SA-4.0", (("ShareAlike", "NonCommercial"), ("BY-SA", "BY-NC"))))
THRESHOLD = 0.8


def bodies() -> tuple[tuple[str, str], ...]:
    """Full licence texts by SPDX identifier."""
    own = {k: files(__package__).joinpath("licenses", f"{k}.txt").read_text("utf-8") for k in BODY_FILES}
    for name, sister, changes in DERIVED:
        text = own[sister]
        for old, new in changes:
            text = text.replace(old, new)
        own[name] = text
    return tuple(sorted(own.items()))


def _tokens(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _lines() -> Column:
    return F.split(text_or_empty(), "\n")


def _line_words(line: Column) -> Column:
    return words_of(lower_ascii(line), TOKEN)


def line_words(docs: DataFrame) -> DataFrame:
    """(w, df): in how many lines of all texts each word stands; the word '' counts the lines."""
    lines = docs.select(F.explode(_lines()).alias("line"))
    found = F.concat(F.array(F.lit("")), F.array_distinct(_line_words(F.col("line"))))
    return written(lines.select(F.explode(found).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")), "license-df")


def template_weights(frequencies: DataFrame, templates=TEMPLATES) -> tuple[list[dict[str, float]], dict[str, int]]:
    """([{word: tf * idf} of each template], {word: lines}), from the document frequencies of ``line_words``."""
    counts = [Counter(_tokens(t)) for _, t in templates]
    vocabulary = sorted(set().union(*counts))
    df = {r["w"]: r["df"] for r in frequencies.where(F.col("w").isin("", *vocabulary)).collect()}  # templates' words only
    idf = {w: math.log((1 + df.get("", 0)) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    return [{w: c * idf[w] for w, c in own.items()} for own in counts], df


#: Words in at least one of so many lines are taken as indispensable only if the rarer ones don't suffice.
COMMON = 50


def _indispensable(weights: list[dict[str, float]], df: dict[str, int], threshold: float) -> set[str]:
    """Words of which every passage that reaches the threshold with some template has one."""
    need = set()
    for own in weights:
        norm = sum(v * v for v in own.values())
        left = norm
        for w, v in sorted(own.items(), key=lambda x: (df.get(x[0], 0) * COMMON > df.get("", 0), -x[1], x[0])):
            if left < threshold * threshold * norm * (1 - 1e-9):
                break
            need.add(w)
            left -= v * v
    return need


def _any_of(words: set[str]) -> str:
    """A pattern of one of ``words`` as a token of either case; words of one first letter share a branch."""
    branches = defaultdict(list)
    for w in sorted(words):
        branches[w[0]].append(w[1:])
    some = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in branches.items())
    # the word boundary of the tokens
    edge = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    return rf"(?i)(?:^|{edge})(?:{some})(?:$|{edge})"


def match_passages(docs: DataFrame, templates, threshold: float = THRESHOLD) -> DataFrame:
    """(key, place, line, n, t, score): passages that reach the threshold with ``templates[t]``; n counts their words.

    ``place`` is line, text (the whole text), or run (the best of the template's length); ``line`` is -1 but for lines.
    """
    spark = docs.sparkSession
    frequencies = line_words(docs)
    weights, df = template_weights(frequencies, templates)
    size = [len(_tokens(t)) for _, t in templates]
    norm = [math.sqrt(sum(v * v for v in own.values())) for own in weights]
    vectors = F.broadcast(spark.createDataFrame([(t, size[t], w, v / norm[t]) for t, own in enumerate(weights) for w, v in sorted(own.items())],
                                                "t int, m int, w string, unit double"))
    hit = _any_of(_indispensable(weights, df, threshold))
    some = docs.where(text_or_empty().rlike(hit)).select(row_key().alias("key"), "text").distinct()
    tokens = written(some.select("key", F.posexplode(_line_words(text_or_empty())).alias("pos", "w")), "license-tokens")
    lines = some.select("key", F.posexplode(_lines()).alias("line", "x")).where(F.col("x").rlike(hit))
    lines = lines.select("key", "line", F.explode(_line_words(F.col("x"))).alias("w"))
    words = written(lines.union(tokens.select("key", F.lit(-1).alias("line"), "w")).groupBy("key", "line", "w").count(), "license-words")
    # every word of a candidate text has its own frequency; only their words are kept of the table
    idf = F.log((1 + F.lit(df.get("", 0))) / (1 + F.col("df"))) + 1
    table = keys(frequencies.join(words.select("w").distinct(), "w", "left_semi").select("w", idf.alias("idf")), "license-idf")
    words = words.join(table, "w").withColumn("weight", F.col("count") * F.col("idf"))
    norms = words.groupBy("key", "line").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.sum("count").alias("n"))
    dots = words.join(vectors, "w").groupBy("key", "line", "t", "m").agg(
        F.sum(F.col("weight") * F.col("unit")).alias("dot"), F.sum(F.col("unit") * F.col("unit")).alias("reach"))
    # no run of a text has a better cosine than the root of the part of the template that the text's words make up
    dots = written(dots.join(norms, ["key", "line"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
                   .where((F.col("score") >= threshold) | ((F.col("line") < 0) & (F.col("reach") >= threshold * threshold * (1 - 1e-5)))),
                   "license-dots")
    fixed = dots.where(F.col("score") >= threshold) \
        .select("key", F.when(F.col("line") < 0, "text").otherwise("line").alias("place"), "line", "n", "t", "score")
    runs = _runs(tokens, table, vectors, dots.where("line < 0 and n > m").select("key", "t", "m", "n"))
    return fixed.union(runs.where(F.col("score") >= threshold).select("key", F.lit("run"), F.lit(-1), F.col("m").cast("long"), "t", "score"))


def _runs(tokens: DataFrame, table: DataFrame, vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, t, m, score): the best cosine of m successive words, for each (key, t, m, n) of ``pairs``."""
    at = tokens.join(pairs, "key").join(table, "w").join(vectors.drop("m"), ["t", "w"], "left")
    steps = F.array(F.struct(F.col("pos").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("pos") + F.col("m")).alias("at"), F.lit(-1).alias("sign")))
    at = at.select("key", "t", "m", "n", "w", "idf", F.coalesce("unit", F.lit(0.0)).alias("unit"), F.inline(steps)).where("at < n")
    upto = Window.partitionBy("key", "t", "w").orderBy("at", "sign").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = at.withColumn("c", F.sum("sign").over(upto))  # how often the run has the word after the step
    square = F.col("c") * F.col("c") - (F.col("c") - F.col("sign")) * (F.col("c") - F.col("sign"))
    moves = held.groupBy("key", "t", "m", "at").agg(F.sum(F.col("sign") * F.col("idf") * F.col("unit")).alias("dot"),
                                                    F.sum(F.col("idf") * F.col("idf") * square).alias("square"))
    so_far = Window.partitionBy("key", "t").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = moves.select("key", "t", "m", "at", F.sum("dot").over(so_far).alias("dot"), F.sum("square").over(so_far).alias("square"))
    return ends.where(F.col("at") >= F.col("m") - 1).groupBy("key", "t", "m").agg(
        F.max(F.round(F.col("dot") / F.sqrt("square"), 6)).alias("score"))


def _named(matches: DataFrame, templates) -> DataFrame:
    """``matches`` with the template's ``license`` in place of its number."""
    names = matches.sparkSession.createDataFrame([(t, k) for t, (k, _) in enumerate(templates)], "t int, license string")
    return matches.join(F.broadcast(names), "t")


def match_lines(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, line, n, license, score): the best template of each line that reaches the threshold; n counts its words."""
    best = _named(match_passages(docs, templates, threshold).where("place = 'line'"), templates)
    return best.groupBy("key", "line", "n").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")) \
        .select("key", "line", "n", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def scan_licenses(docs: DataFrame, path: Column | None = None, templates=TEMPLATES, threshold: float = THRESHOLD,
                  texts=None) -> DataFrame:
    """doc_id, license, score, origin (header, file, inherited or null), from_dir: one row per row of ``docs``.

    ``path`` is the text's directory, by default source/lang; ``texts`` the licence bodies, by default ``bodies()``.
    """
    if path is None:
        path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    notices = len(templates)
    templates = (*templates, *(bodies() if texts is None else texts))
    found = _named(match_passages(docs, templates, threshold), templates)
    rank = F.when(F.col("place") == "text", 0).when(F.col("t") >= notices, 1).otherwise(2)
    # a line counts once, however many templates it matches
    found = found.groupBy("key", "place", "line").agg(
        F.max("n").alias("n"), F.min(F.struct(rank.alias("rank"), (-F.col("score")).alias("s"), "license")).alias("b"))
    found = written(found.groupBy("key").agg(F.sum(F.when(F.col("place") == "line", F.col("n")).otherwise(0)).alias("matched"),
                                             F.max(F.col("place") == "text").alias("whole"), F.min("b").alias("b"))
                    .select("key", "matched", "whole", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")), "license-found")
    rows = docs.select("doc_id", path.alias("dir"), row_key().alias("key"),
                       count_tokens().alias("n"))
    rows = written(rows.join(found, "key", "left").withColumn("origin", F.when(F.col("license").isNull(), F.lit(None).cast("string")).when(
        F.col("whole") | (2 * F.col("matched") >= F.col("n")), F.lit("file")).otherwise(F.lit("header"))), "license-rows")
    dirs = rows.where("origin = 'file'").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")) \
        .select(F.col("dir").alias("from_dir"), F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    # each distinct directory finds its nearest ancestor once; the rows then join their directory
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("from_dir")))
    near = keys(rows.where("license is null").select("dir").distinct().select("dir", F.explode(up).alias("u")).select("dir", "u.*") \
        .join(dirs, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "dir_license", "dir_score")).alias("near")), "license-near")
    out = rows.join(near, "dir", "left")
    take = F.col("license").isNull() & F.col("near").isNotNull()
    return out.select("doc_id", F.when(take, F.col("near.dir_license")).otherwise(F.col("license")).alias("license"),
                      F.when(take, F.col("near.dir_score")).otherwise(F.col("score")).alias("score"),
                      F.when(take, F.lit("inherited")).otherwise(F.col("origin")).alias("origin"),
                      F.when(take, F.col("near.from_dir")).alias("from_dir"))
