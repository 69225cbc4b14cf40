"""Suffix-array dedup: every byte of a string of ``length`` bytes that also starts elsewhere is removed.

1. Anchors.  Each start p of a ``length``-byte string has a canonical anchor: the k-gram with the least hash in the
   string (the last of equals).  It depends on the string alone, so equal strings have anchors of equal hash at the
   same distance.  Starts with the same anchor are consecutive: a context is the bytes from its first start to
   the end of its last string.
2. Only anchors whose hash occurs at two places can have repeats; the rest of the corpus is settled by one count.
3. Equal contexts collapse to one, with their number; those that occur twice are repeated throughout.
4. Where contexts of one anchor hash differ, their bytes are suffix-sorted by the difference-cover algorithm: sampled
   triples (positions 1 and 2 modulo 3) are sorted and named, names are sorted recursively, the remaining
   suffixes are sorted by their first byte and the rank after it, and both are merged.  Adjacent suffixes that
   agree in ``length`` bytes are repeats.  Equal strings share the anchor hash, so sorting the contexts of
   each hash apart, many hashes to a block, finds all of them, and Spark deals the hashes out.
5. An anchor hash with more contexts than a block holds is settled by counting its strings' hashes, a grouped count
   with partial sums, so no task ever holds such a group.

Defined results: a null text is empty; texts shorter than ``length`` bytes lose nothing; copies of a text are removed
whole if it has ``length`` bytes (strings are judged on the input); repeated or null ids are ordinary rows; ties and
repeated rows get the same answer each; very long texts are scanned whole, by pieces; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, text_or_empty, written


@dataclass(frozen=True)
class SuffixConfig:
    length: int = 400
    gram: int = 64
    block: int = (1 << 21) - 8  # bytes that are suffix-sorted at a time: names and ranks have 21 bits

    task_bytes: int = 64 << 20  # a task that sorts blocks gets about so much, if that takes more tasks than shuffles have
    piece: int = 1 << 20  # starts of a text that are scanned at a time, to bound memory on long texts

    @property
    def max_contexts(self) -> int:
        return self.block // (2 * self.length)


# -- anchors --------------------------------------------------------------------------------------

_TABLE = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram``-byte string, by doubling (``gram`` is a power of two)."""
    h, n = _TABLE[np.frombuffer(data, np.uint8)], 1
    with np.errstate(over="ignore"):
        while n < gram:
            h = _mix(h[:-n] * np.uint64(0x9E3779B97F4A7C15) + _mix(h[n:] + np.uint64(n)))
            n *= 2
    return h


def anchors(data: bytes, config: SuffixConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start) of each context of a text: runs of starts with the same anchor."""
    if len(data) < config.length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data, config.gram)
    width = config.length - config.gram + 1  # k-grams of a string
    # the place of the last least hash of each window: suffix minima and prefix minima of blocks of the window's size
    n = len(h)
    pad = -n % width
    full = np.concatenate([h, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    at = np.arange(n + pad).reshape(-1, width)
    left = np.minimum.accumulate(full[:, ::-1], axis=1)
    # from the right, a place replaces the ones after it only if it is smaller; from the left also if it is equal
    new = np.concatenate([np.ones((len(full), 1), bool), full[:, ::-1][:, 1:] < left[:, :-1]], axis=1)
    left_at = _carry(new, at[:, ::-1])[:, ::-1].ravel()
    left = left[:, ::-1].ravel()
    right = np.minimum.accumulate(full, axis=1)
    new = np.concatenate([np.ones((len(full), 1), bool), full[:, 1:] <= right[:, :-1]], axis=1)
    right_at, right = _carry(new, at).ravel(), right.ravel()
    first, last = np.arange(n - width + 1), np.arange(width - 1, n)
    place = np.where(right[last] <= left[first], right_at[last], left_at[first])
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return h[place[cut]], cut, np.append(cut[1:], len(place)) - 1


def _carry(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Along each row, the value where ``new`` was last true."""
    index = np.maximum.accumulate(np.where(new, np.arange(new.shape[1]), 0), axis=1)
    return np.take_along_axis(values, index, axis=1)


# -- suffix sorting -------------------------------------------------------------------------------

def _ranks(keys_: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(keys_, kind="stable")
    sorted_ = keys_[order]
    new = np.concatenate([[1], (sorted_[1:] != sorted_[:-1]).astype(np.int64)])
    names = np.empty(len(keys_), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s`` (values from 1, below 2 ** 21) by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(4, np.int64)]).astype(np.uint64)
    b = np.uint64(21)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a dummy at n keeps both samples in step
    sample = np.concatenate([one, two])
    names, kinds = _ranks((t[sample] << (b + b)) | (t[sample + 1] << b) | t[sample + 2])
    if kinds < len(sample):
        order = suffix_array(names)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 4, np.uint64)
    rank[sample] = names.astype(np.uint64)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort((t[zero] << b) | rank[zero + 1], kind="stable")]
    # merge: against suffixes of either residue, a remaining suffix compares by one or two values and a rank
    of1, of2 = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted((t[of1] << b) | rank[of1 + 1], (t[zero] << b) | rank[zero + 1]) \
        + np.searchsorted((t[of2] << (b + b)) | (t[of2 + 1] << b) | rank[of2 + 2], (t[zero] << (b + b)) | (t[zero + 1] << b) | rank[zero + 2])
    out = np.empty(n, np.int64)
    slots = before + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[slots] = False
    out[slots], out[rest] = zero, sampled
    return out


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each context, which of its strings of ``length`` bytes also start elsewhere in ``contexts``."""
    end = np.array([256], np.int64)  # ends a context, equals no byte
    text = np.concatenate([x for c in contexts for x in (np.frombuffer(c, np.uint8).astype(np.int64), end)]) + 1
    starts = np.cumsum([0, *[len(c) + 1 for c in contexts]])
    inside = np.zeros(len(text), bool)
    for at, c in zip(starts, contexts):
        inside[at:at + len(c) - length + 1] = True
    order = suffix_array(text)
    order = order[inside[order]]
    a, b = order[:-1], order[1:]
    packed = np.zeros(len(text) + 8, np.uint64)  # eight bytes from each place
    low = np.concatenate([(text - 1).astype(np.uint64) & np.uint64(255), np.zeros(8, np.uint64)])
    for k in range(8):
        packed[:len(text)] |= low[k:k + len(text)] << np.uint64(8 * k)
    same = np.arange(len(a))
    offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for k in offsets:  # compare adjacent prefixes
        same = same[packed[a[same] + k] == packed[b[same] + k]]
    hit = np.zeros(len(text), bool)
    hit[a[same]] = hit[b[same]] = True
    return [hit[at:at + len(c) - length + 1] for at, c in zip(starts, contexts)]


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(x), "z": int(y)} for x, y in zip(edge[::2], edge[1::2])]


# -- Spark ----------------------------------------------------------------------------------------

def _bytes(value) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def _text_keys(text: str = "text") -> list[Column]:
    return [F.xxhash64(text_or_empty(text)).alias("k1"), F.xxhash64(F.lit(1), text_or_empty(text)).alias("k2")]


def _contexts(docs: DataFrame, config: SuffixConfig) -> DataFrame:
    """(fp, x1, x2, k1, k2, first, n, bytes): contexts whose anchor hash occurs at two places, once per text."""
    def find(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                b = batch.slice(start, 200)
                out = ([], [], [], [], [])
                for k1, k2, t in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text").to_pylist()):
                    data = _bytes(t)
                    for at in range(0, max(1, len(data) - config.length + 1), config.piece):  # starts by pieces
                        h, lo, hi = anchors(data[at:at + config.piece + config.length - 1], config)
                        for x, y in zip(out, (h.view(np.int64), lo + at, hi + at, np.full(len(h), k1, np.int64),
                                              np.full(len(h), k2, np.int64))):
                            x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out],
                                                 ["fp", "first", "last", "k1", "k2"])

    texts = docs.select(*_text_keys(), "text")
    found = written(texts.mapInArrow(find, "fp long, first long, last long, k1 long, k2 long"), "suffix-anchors")
    place = F.xxhash64("k1", "k2", "first")
    twice = found.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("fp")
    # how many repeat grows with the corpus: written, so that each side of the join is a shuffle whose large keys can be split
    wanted = found.join(written(twice, "suffix-twice"), "fp").groupBy("k1", "k2").agg(
        F.collect_set(F.struct("fp", "first", "last")).alias("at"))  # of one text
    wanted = written(wanted, "suffix-wanted")
    some = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))  # copies fold before they travel

    def cut(batches):
        names = ["fp", "x1", "x2", "k1", "k2", "first", "n", "bytes"]
        types = [pa.int64()] * 7 + [pa.binary()]
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        for b in batches:
            rows, size = [], 0
            for k1, k2, t, at in zip(*[b.column(c) for c in ("k1", "k2", "text", "at")]):
                data = _bytes(t.as_py())
                for a in at.as_py():
                    x = data[a["first"]:a["last"] + config.length]
                    d = xxhash.xxh3_128_intdigest(x)
                    rows.append((a["fp"], signed(d >> 64), signed(d & (2**64 - 1)), k1.as_py(), k2.as_py(), a["first"],
                                 a["last"] - a["first"] + 1, x))
                    size += len(x) + 100
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return written(some.join(wanted, ["k1", "k2"]).mapInArrow(
        cut, "fp long, x1 long, x2 long, k1 long, k2 long, first long, n long, bytes binary"), "suffix-contexts")


def repeated_runs(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """(k1, k2, at): per text, the runs of starts of repeated strings, as sorted (a, z) with z exclusive."""
    contexts = _contexts(docs, config)
    context = ["fp", "x1", "x2"]
    distinct = written(contexts.groupBy(*context).agg(F.count("*").alias("m"), F.max("n").alias("n"), F.first("bytes").alias("bytes")),
                       "suffix-distinct")
    groups = written(distinct.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-groups")
    mixed = distinct.join(groups, "fp")
    run = "array<struct<a:long,z:long>>"

    def sort_blocks(batches):
        def settle(rows):
            flags = repeated_starts([r[4] for r in rows], config.length)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                + [pa.array([_runs(f | (r[3] > 1)) for r, f in zip(rows, flags)], pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))],
                [*context, "runs"])

        block, size, group = [], 0, []
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in (*context, "m", "bytes")]):
                if group and group[-1][0] != row[0]:
                    block, size, group = block + group, size, []
                if size + len(row[4]) + 1 > config.block and block:
                    yield settle(block)
                    block, size = [], sum(len(r[4]) + 1 for r in group)
                group.append(row)
                size += len(row[4]) + 1
        if block or group:
            yield settle(block + group)

    small = mixed.where(F.col("kinds") <= config.max_contexts).select(*context, "m", "bytes")
    # of a context's bytes, without reading them: its starts and the rest of the last string
    size = mixed.where(F.col("kinds") <= config.max_contexts).agg(F.sum(F.col("n") + config.length - 1)).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // config.task_bytes))
    sorted_ = small.repartition(parts, "fp").sortWithinPartitions("fp").mapInArrow(sort_blocks, f"fp long, x1 long, x2 long, runs {run}")

    def strings(batches):
        for b in batches:
            for fp, x1, x2, m, data in zip(*[b.column(c).to_pylist() for c in (*context, "m", "bytes")]):
                n = len(data) - config.length + 1
                h = [xxhash.xxh3_128_intdigest(data[i:i + config.length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, v, np.int64)) for v in (fp, x1, x2, m)] + [pa.array(np.arange(n))]
                    + [pa.array(np.array([x >> 64 for x in h], np.uint64).view(np.int64)),
                       pa.array(np.array([x & (2**64 - 1) for x in h], np.uint64).view(np.int64))], [*context, "m", "i", "s1", "s2"])

    large = mixed.where(F.col("kinds") > config.max_contexts).select(*context, "m", "bytes").mapInArrow(
        strings, "fp long, x1 long, x2 long, m long, i long, s1 long, s2 long")
    again = large.groupBy("s1", "s2").agg(F.sum("m").alias("times")).where("times > 1").drop("times")
    counted = large.join(again, ["s1", "s2"]).groupBy(*context).agg(
        F.collect_list(F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("z"))).alias("runs"))
    alone = distinct.where("m > 1").join(groups, "fp", "left_anti").select(
        *context, F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("z"))).alias("runs"))
    runs = written(sorted_.union(counted).union(alone).where(F.size("runs") > 0), "suffix-runs")
    placed = contexts.select(*context, "k1", "k2", "first").join(runs, context)
    return placed.select("k1", "k2", F.explode("runs").alias("r"), "first").groupBy("k1", "k2").agg(F.array_sort(F.collect_list(
        F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.z")).alias("z")))).alias("at"))


def _removed(at: list[dict], n: int, whole: bool, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes."""
    if whole:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    for r in at or []:
        a, z = r["a"], r["z"] + length - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def dedup(docs: DataFrame, config: SuffixConfig = SuffixConfig(), keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) on demand: one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    texts = docs.select("doc_id", *_text_keys(), "text")
    copies = texts.where(F.octet_length("text") >= config.length).groupBy("k1", "k2").agg(F.count("*").alias("m")).where("m > 1")
    copies = copies.select("k1", "k2", F.lit(True).alias("whole"))
    marks = settled(docs.sparkSession, "suffix-marks", lambda: repeated_runs(docs, config).join(copies, ["k1", "k2"], "full"))

    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]

    def cut(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                rows = []
                for t, at, whole in zip(b.column("text").to_pylist(), b.column("at").to_pylist(), b.column("whole").to_pylist()):
                    data = _bytes(t)
                    gone = _removed(at, len(data), bool(whole), config.length)
                    keep, last = [], 0
                    for a, z in gone:
                        keep.append(data[last:a])
                        last = z
                    kept = b"".join([*keep, data[last:]])
                    rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
                cols = list(zip(*rows))
                arrays = [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(cols[4], pa.binary())] if keep_text else [])], names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    out = texts.join(marks, ["k1", "k2"], "left")
    return out.select("doc_id", "text", "at", "whole").mapInArrow(cut, schema)
