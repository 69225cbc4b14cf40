"""Ranked lexical search by MaxScore with bounds on pairs of terms.

The index has a row for each block of about a megabyte of texts: its documents, and an inverted list for each
term.  Making it moves no postings between tasks.  For a set of queries, a pass over the index writes the impact
lists of their terms (the score that one occurrence in the query gives a document) with their maxima, and
intersects the lists of the pairs of terms that the queries hold side by side in order of weight: the pair's joint
maximum is the highest sum of both impacts in one document of the block.

At query time a pair's bound is max(one alone, the other alone, joint maximum), which is below the sum of the two
term maxima wherever the two best documents differ.  The bounds of a query's pairs add up to the block's bound:
blocks that can't reach the query's threshold are skipped; in others, the pairs with the lowest bounds that
together can't reach it are looked up only for documents that the rest have found, and those are dropped once
what they have and what is left to come falls short.  The threshold is the k-th best score so far in the task, and
at first the k-th best single or joint maximum among all blocks, which lie in different documents.  Bounds never
drop a score that is equal to the threshold, so the result is exact.

Bounded state: a block (a few at a time, read and written in row groups of some), a batch of documents, a task's k best for each query, and one set of queries at a time, cut by their number of
terms.  Queries beyond a set take another pass over the index, never a larger driver.

Defined results: null, empty and termless texts are no documents and ask for nothing; equal rows of the documents
are documents of their own, equal scores are ordered by id, null ids last; equal rows of the queries are one
query, and queries with equal ids and different texts are ranked each for itself.  Very long texts are a block of their
own.  Without documents or queries the result is empty.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, rows_per_batch, written

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class SearchConfig:
    k: int = 20
    block_bytes: int = 1 << 20
    block_docs: int = 4096
    set_terms: int = 100_000  # terms of the queries that are answered in one pass
    batch_blocks: int = 8  # blocks that a worker is handed at a time
    batch_docs: int = 512  # documents that a worker is handed at a time


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


# -- the index --------------------------------------------------------------------------------------

def _block(ids: list, texts: list[list[bytes]], id_type) -> pa.RecordBatch:
    """One row: ids, n (terms with repeats), terms, df, and docs and tfs of all lists end to end."""
    n = np.array([len(t) for t in texts], np.int64)
    flat = [w for t in texts for w in t]
    code = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    which = np.fromiter(map(code.__getitem__, flat), np.int64, len(flat))
    key, tf = np.unique(which * len(ids) + np.repeat(np.arange(len(ids)), n), return_counts=True)
    term, doc = key // len(ids), key % len(ids)
    row = [pa.array([ids], pa.list_(id_type)), pa.array([n]), pa.array([list(code)], pa.list_(pa.binary())),
           pa.array([np.bincount(term, minlength=len(code)).astype(np.int32)]), pa.array([doc.astype(np.int32)]), pa.array([tf])]
    return pa.RecordBatch.from_arrays(row, ["ids", "n", "terms", "df", "docs", "tfs"])


def build_index(docs: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """The written index of ``docs`` (doc_id, text): a row for each block, with every document that has a term."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        ids, texts, size = [], [], 0
        id_type = pa.int64()
        for b in batches:
            id_type = b.column("doc_id").type
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                raw = text.as_py()
                found = terms_of(raw)
                if not found:
                    continue
                if ids and size + len(raw) > config.block_bytes:
                    yield _block(ids, texts, id_type)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(found)
                size += len(raw)
                if len(ids) >= config.block_docs:
                    yield _block(ids, texts, id_type)
                    ids, texts, size = [], [], 0
        if ids:
            yield _block(ids, texts, id_type)

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    index = rows.mapInArrow(run, f"ids array<{kind}>, n array<long>, terms array<binary>, df array<int>, docs array<int>, tfs array<long>")
    with rows_per_batch(docs.sparkSession, config.batch_docs):
        return written(index, "search-index", LARGE_ROWS)


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """(documents, their terms with repeats)."""
    r = index.select(F.size("n").cast("long").alias("d"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("t")) \
        .agg(F.sum("d"), F.sum("t")).first()
    return r[0] or 0, r[1] or 0


def _numbers(column, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def document_frequencies(index: DataFrame, terms: list[bytes]) -> np.ndarray:
    """The number of documents that hold each of ``terms``."""
    def run(batches):
        asked, df = pa.array(terms, pa.binary()), np.zeros(len(terms), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                at = pc.fill_null(pc.index_in(b.column("terms")[i].values, asked), -1).to_numpy()
                df[at[at >= 0]] += _numbers(b.column("df"), i)[at >= 0]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], ["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "df").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


# -- a set of queries ---------------------------------------------------------------------------------

class _Queries:
    """The terms of a set of queries and, end to end, their groups: pairs (a, b) or single terms (b = -1)."""

    def __init__(self, rows: list, weigh):
        self.ids = [r["item_id"] for r in rows]
        self.terms = sorted({bytes(t) for r in rows for t in r["terms"]})
        code = {t: i for i, t in enumerate(self.terms)}
        self.weight = weigh(self.terms)
        pairs: dict[tuple[int, int], int] = {}
        a, b, qa, qb, pair, ends = [], [], [], [], [], []
        for r in rows:
            times = Counter({code[bytes(t)]: q for t, q in zip(r["terms"], r["times"])})
            order = sorted((t for t in times if self.weight[t] > 0), key=lambda t: (-self.weight[t], t))
            for i in range(0, len(order), 2):
                two = order[i:i + 2]
                both = (min(two), max(two)) if len(two) == 2 else (two[0], -1)
                a.append(both[0]), b.append(both[1]), qa.append(times[both[0]]), qb.append(times.get(both[1], 0))
                pair.append(pairs.setdefault(both, len(pairs)) if len(two) == 2 else -1)
            ends.append(len(a))
        self.pairs = np.array(list(pairs), np.int64).reshape(-1, 2)
        self.a, self.b, self.qa, self.qb, self.pair, self.ends = (np.array(x, np.int64) for x in (a, b, qa, qb, pair, ends))

    def bounds(self, best: np.ndarray, joint: np.ndarray) -> np.ndarray:
        """Upper bounds of the groups; best has a last place that stays 0, for the missing halves."""
        one, two = self.qa * best[self.a], self.qb * best[self.b]
        both = np.minimum(one + two, np.maximum(self.qa, self.qb) * joint[self.pair])
        return np.maximum(np.maximum(one, two), both)

    def floors(self, kth: np.ndarray, joint_kth: np.ndarray) -> np.ndarray:
        """For each query, a score that k documents reach, from the k-th best single and joint maxima."""
        least = np.maximum(np.maximum(self.qa * kth[self.a], self.qb * kth[self.b]), np.minimum(self.qa, self.qb) * joint_kth[self.pair])
        starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        return np.array([least[s:e].max(initial=0) for s, e in zip(starts, self.ends)], np.int64)


def _impact_lists(index: DataFrame, q: _Queries, n_docs: int, n_terms: int) -> DataFrame:
    """A written row for each block: ids, the asked terms with their lists of docs and impacts, their maxima, and
    the pairs that meet in a document with their joint maxima."""
    terms, weight, pairs = q.terms, q.weight, q.pairs

    def row(b, i, asked):
        at = pc.fill_null(pc.index_in(b.column("terms")[i].values, asked), -1).to_numpy()
        at = np.where((at >= 0) & (weight[at] > 0), at, -1)
        if not (at >= 0).any():
            return None
        df, n = _numbers(b.column("df"), i), _numbers(b.column("n"), i)
        mine = np.repeat(at >= 0, df)
        doc, tf = _numbers(b.column("docs"), i)[mine], _numbers(b.column("tfs"), i)[mine]
        lengths, where = np.unique(n, return_inverse=True)
        m = np.array([75 + 25 * int(x) * n_docs // n_terms for x in lengths], np.int64)[where]
        have, df = at[at >= 0], df[at >= 0].astype(np.int64)
        impact = np.repeat(weight[have], df) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        starts = np.cumsum(df) - df
        slot = np.full(len(terms), -1)
        slot[have] = np.arange(len(have))
        near = np.zeros(len(n), np.int64)
        met, joint = [], []
        sa, sb = (slot[pairs[:, 0]], slot[pairs[:, 1]]) if len(pairs) else (slot[:0], slot[:0])
        for p in np.flatnonzero((sa >= 0) & (sb >= 0)):
            x, y = slice(starts[sa[p]], starts[sa[p]] + df[sa[p]]), slice(starts[sb[p]], starts[sb[p]] + df[sb[p]])
            near[doc[x]] = impact[x]
            other = near[doc[y]]
            if other.any():
                met.append(p)
                joint.append(int((other + impact[y])[other > 0].max()))
            near[doc[x]] = 0
        return [b.column("ids")[i].as_py(), have.astype(np.int32), df.astype(np.int32), doc, impact,
                np.maximum.reduceat(impact, starts), np.array(met, np.int32), np.array(joint, np.int64)]

    def run(batches):
        asked = pa.array(terms, pa.binary())
        for b in batches:
            for i in range(b.num_rows):
                found = row(b, i, asked)
                if found:
                    id_type = b.column("ids").type
                    types = [id_type if pa.types.is_list(id_type) else pa.list_(pa.int64()), *map(pa.list_, (
                        pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(found, types)], names)

    names = ["ids", "have", "df", "docs", "impacts", "best", "met", "joint"]
    kind = dict(index.dtypes)["ids"]
    return written(index.mapInArrow(run, f"ids {kind}, have array<int>, df array<int>, docs array<int>, impacts array<long>, "
                                         "best array<long>, met array<int>, joint array<long>"), "search-lists", LARGE_ROWS)


def _kth(lists: DataFrame, keys: str, best: str, size: int, k: int) -> np.ndarray:
    """The k-th highest of each key's maxima over all blocks; 0 where there are fewer."""
    out = np.zeros(size + 1, np.int64)
    rows = lists.select(F.explode(F.arrays_zip(keys, best)).alias("x")).select(F.col(f"x.{keys}").alias("key"), F.col(f"x.{best}").alias("best"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("best")))
    for r in rows.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("key", "best").collect():
        out[r["key"]] = r["best"]
    return out


def _scored(q: _Queries, groups: slice, order: np.ndarray, bound: np.ndarray, lists, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(docs, scores) of the documents of a block that reach ``least``, by MaxScore over the query's groups."""
    g = np.arange(groups.start, groups.stop)[order]  # by bound, lowest first
    below = np.cumsum(bound[g])
    first = int(np.searchsorted(below, least, "left"))  # groups before it can't reach the threshold together
    score = np.zeros(size, np.int64)
    for j in g[first:]:
        for term, times in ((q.a[j], q.qa[j]), (q.b[j], q.qb[j])):
            if times and (found := lists(term)):
                score[found[0]] += times * found[1]
    left = below[first - 1] if first else 0
    docs = np.flatnonzero(score)
    docs = docs[score[docs] + left >= least]
    for j in g[:first][::-1]:
        if not len(docs):
            break
        for term, times in ((q.a[j], q.qa[j]), (q.b[j], q.qb[j])):
            if times and (found := lists(term)):
                at = np.minimum(np.searchsorted(found[0], docs), len(found[0]) - 1)
                score[docs] += np.where(found[0][at] == docs, times * found[1][at], 0)
        left -= bound[j]
        docs = docs[score[docs] + left >= least]
    return docs, score[docs]


def _best_of_blocks(lists: DataFrame, q: _Queries, floors: np.ndarray, k: int, kind: str) -> DataFrame:
    """(q, doc_id, score): for each query and task, the k best documents of the task's blocks."""
    n_terms, n_pairs = len(q.terms), len(q.pairs)
    starts = np.concatenate([[0], q.ends[:-1]]).astype(np.int64)

    def run(batches):
        top: list[list[tuple]] = [[] for _ in q.ids]
        least = np.maximum(floors, 1)
        id_type = pa.int64()
        for b in batches:
            id_type = b.column("ids").type.value_type
            for i in range(b.num_rows):
                best, joint = np.zeros(n_terms + 1, np.int64), np.zeros(n_pairs + 1, np.int64)
                have, df = _numbers(b.column("have"), i), _numbers(b.column("df"), i).astype(np.int64)
                best[have] = _numbers(b.column("best"), i)
                joint[_numbers(b.column("met"), i)] = _numbers(b.column("joint"), i)
                bound = q.bounds(best, joint)
                total = np.concatenate([[0], np.cumsum(bound)])
                reach = total[q.ends] - total[starts]
                docs, impacts, ends = _numbers(b.column("docs"), i), _numbers(b.column("impacts"), i), np.cumsum(df)
                slot = np.full(n_terms + 1, -1)
                slot[have] = np.arange(len(have))

                def listed(term):
                    s = slot[term]
                    return (docs[ends[s] - df[s]:ends[s]], impacts[ends[s] - df[s]:ends[s]]) if s >= 0 else None

                ids = b.column("ids")[i].values
                for x in np.flatnonzero(reach >= least):
                    part = slice(int(starts[x]), int(q.ends[x]))
                    found, score = _scored(q, part, np.argsort(bound[part], kind="stable"), bound, listed, len(ids), int(least[x]))
                    if len(found) > k:  # ties with the k-th stay, for their ids decide
                        stay = score >= np.partition(score, len(score) - k)[len(score) - k]
                        found, score = found[stay], score[stay]
                    if len(found):
                        new = [(-s, d is None, d) for s, d in zip(score.tolist(), ids.take(pa.array(found)).to_pylist())]
                        top[x] = sorted(top[x] + new, key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[:k]
                        if len(top[x]) == k:
                            least[x] = max(least[x], -top[x][-1][0])
        rows = [(x, r[2], -r[0]) for x, t in enumerate(top) for r in t]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type),
                                          pa.array([r[2] for r in rows], pa.int64())], ["q", "doc_id", "score"])

    return lists.mapInArrow(run, f"q int, doc_id {kind}, score long")


def _asked(queries: DataFrame) -> DataFrame:
    """(item_id, text, terms, times) of the distinct queries that have a term."""
    kind = dict(queries.dtypes)["item_id"]

    def run(batches):
        for b in batches:
            count = [Counter(terms_of(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([list(c) for c in count], pa.list_(pa.binary())), pa.array(
                [list(c.values()) for c in count], pa.list_(pa.int32()))], ["item_id", "terms", "times"])

    rows = queries.select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    return written(rows.mapInArrow(run, f"item_id {kind}, terms array<binary>, times array<int>").where(F.size("terms") > 0), "search-queries")


def search(index: DataFrame, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query (item_id, text) with a score above 0."""
    spark = index.sparkSession
    kind, item = dict(index.dtypes)["ids"][len("array<"):-1], dict(queries.dtypes)["item_id"]
    n_docs, n_terms = corpus_size(index)
    asked = _asked(queries)
    sets = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // config.set_terms)
    found = []
    for s in range(sets if n_docs else 0):
        rows = asked.where(F.pmod(F.hash("item_id", "terms"), F.lit(sets)) == s).collect()
        if not rows:
            continue

        def weigh(terms):
            df = document_frequencies(index, terms).tolist()
            return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df], np.int64)

        with rows_per_batch(spark, config.batch_blocks):
            q = _Queries(rows, weigh)
            lists = _impact_lists(index, q, n_docs, n_terms)
            floors = q.floors(_kth(lists, "have", "best", len(q.terms), config.k), _kth(lists, "met", "joint", len(q.pairs), config.k))
        names = spark.createDataFrame([(i, x) for i, x in enumerate(q.ids)], f"q int, item_id {item}")
        with rows_per_batch(spark, config.batch_blocks):
            best = written(_best_of_blocks(lists, q, floors, config.k, kind), "search-best")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = best.withColumn("rank", rank).where(F.col("rank") <= config.k)
        found.append(best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], f"item_id {item}, rank int, doc_id {kind}, score long")
