"""Language-model scores by an interpolated modified Kneser-Ney bigram model, counted in Spark.

Words are 64-bit hashes.  A task counts its texts in chunks of about two million tokens and sends each chunk's
distinct keys, sorted and packed, to the shard of the key; a shard merges them and writes them as sorted arrays to the
shared folder, where workers map them into memory.  Two kinds of arrays are stored:

* the vocabulary by ranges of the hash: hashes, running token counts, and continuation counts; a word's id is its
  place among all hashes;
* the bigrams by ranges of equal mass: a bigram's place is the running count of its first word plus a share of that
  word's own count by the second word's id.  So shards are even whatever the words are: a word that begins a third of
  all bigrams is spread over a third of the shards.  The statistics of a word that lies in several shards are
  added up on the driver, at most two words for each shard.

Scoring routes each token's bigram to its shard as well, where the arrays are looked up in sorted order, and
adds up the sums of each chunk's documents.  No task holds more of the model than a shard and the words of its chunk.

    p(w | v) = (max(c(vw) - D(c(vw)), 0) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) p(w)) / c(v)
    p(w)     = (max(a(w) - D'(a(w)), 0) + (D1' n1 + D2' n2 + D3' n3) / (V + 1)) / a

where a(w) counts the words that precede w, and the discounts come from the counts of counts.  A text starts after a
begin mark, which is a context but no token, and ends with an end token.  A word that isn't in the vocabulary takes
the share of V + 1; after such a word, p(w) holds.

Defined results: a null or empty text has one token, its end; a null id counts as the empty text for the split; equal
rows count and are scored each; with nothing to learn from, every token has the probability 1; an empty table gives
an empty result.  A very long text is a chunk of its own.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, written

_END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line end
_W_BITS = 36  # word ids; what is left of a key's 63 bits is the place of its context in the shard


@dataclass(frozen=True)
class LmConfig:
    chunk_tokens: int = 2_000_000
    shard_mass: int = 1 << 22  # tokens; grows up to 2**26 for large corpora, so that shards stay few
    part_bytes: int = 256 << 20  # of text for each range of the vocabulary, of which there are at most 4096


@dataclass
class Model:
    """Where the arrays are, and what is known about all of them."""

    bits: int  # of the hash that name a part of the vocabulary
    sizes: np.ndarray  # words of each part
    masses: np.ndarray  # tokens of each part
    words: dict = field(default_factory=dict)  # part -> file: hashes, running counts
    follows: dict = field(default_factory=dict)  # part -> file: continuation counts
    shards: dict = field(default_factory=dict)  # shard -> (file, bigrams, contexts, bytes of a count and of a statistic)
    mass: int = 1
    starts: int = 0  # training texts, the count of the begin mark
    split: np.ndarray | None = None  # rows (running count, c, n1, n2, n3) of the first and last context of each shard
    discounts: tuple = (0.0, 0.0, 0.0)
    low: tuple = (0.0, 0.0, 0.0)  # discounts of the continuation counts
    kinds: tuple = (0, 0, 0)  # words with a continuation count of 1, 2, 3 or more
    bigrams: int = 0

    @property
    def n_words(self) -> int:
        return int(self.sizes.sum())

    @property
    def n_tokens(self) -> int:
        return int(self.masses.sum())


def in_training(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 != 2


# -- arrays in files ----------------------------------------------------------------------------------

def _pack(a: np.ndarray) -> bytes:
    """The bytes of an array by their place in the number, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(blob: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(blob[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).reshape(n)


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=a.dtype.type(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


def _narrow(a: np.ndarray) -> np.ndarray:
    """Numbers in four bytes where all of them fit, in eight otherwise."""
    return a.astype(np.uint32 if not len(a) or a.max() < 2**32 else np.uint64)


def _store(base: str, arrays: list[np.ndarray]) -> str:
    """Write arrays end to end; a retried task writes another file, and only one of them is named."""
    path = f"{base}/{uuid.uuid4().hex}.arrays"
    fs, root = pafs.FileSystem.from_uri(base)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    return path


def _mapped(path: str) -> np.ndarray:
    """A file's bytes: mapped where the shared folder is mounted, else read."""
    fs, name = pafs.FileSystem.from_uri(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, np.uint8, "r") if fs.get_file_info(name).size else np.zeros(0, np.uint8)
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), np.uint8)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


class _Merge:
    """Merges packed pieces, compacting whenever twice as much as at the last time has come."""

    def __init__(self):
        self.keys, self.counts, self.size, self.limit = [], [], 0, 1 << 22

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > self.limit:
            k, c = self.done()
            self.keys, self.counts, self.size, self.limit = [k], [c], len(k), max(1 << 22, 2 * len(k))

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        return _merged(self.keys, self.counts)


# -- texts ----------------------------------------------------------------------------------------------

def _hashes(text: bytes | None) -> np.ndarray:
    """The hashes of a text's words and its end; lower() and split() of bytes know ASCII only, as asked."""
    found = (text or b"").lower().split()
    out = np.empty(len(found) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    out[-1] = _END
    return out


def _chunked(batches, config: LmConfig):
    """(chunk, rows, tokens): batch-column values of some documents, and their token hashes."""
    part, seq, rows, tokens, size = TaskContext.get().partitionId(), 0, [], [], 0
    for b in batches:
        others = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "text"]
        for i, text in enumerate(b.column("text")):
            tokens.append(_hashes(text.as_py()))
            rows.append([c[i].as_py() for c in others])
            size += len(tokens[-1])
            if size >= config.chunk_tokens:
                yield (part << 32) + seq, rows, tokens
                seq, rows, tokens, size = seq + 1, [], [], 0
    if rows:
        yield (part << 32) + seq, rows, tokens


def _grouped(batches, key: str):
    """(key, row dicts) of rows that come sorted by key; a group's rows are taken one at a time."""
    rows = ({n: b.column(n)[i].as_py() for n in b.schema.names} for b in batches for i in range(b.num_rows))
    return groupby(rows, key=lambda r: r[key])


def _together(df: DataFrame, key: str, *then: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *then)


class _Words:
    """The vocabulary as a worker sees it: parts are mapped when a chunk asks for them."""

    def __init__(self, model: Model):
        self.m, self.open = model, {}
        self.first = np.concatenate([[0], np.cumsum(model.sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(model.masses)]).astype(np.int64)

    def _part(self, kind: str, p: int) -> np.ndarray:
        if (kind, p) not in self.open:
            a = _mapped(getattr(self.m, kind)[p])
            self.open[kind, p] = a.view(np.uint64 if kind == "words" else f"u{len(a) // int(self.m.sizes[p])}")
        return self.open[kind, p]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, running counts, counts) of sorted hashes; an unknown word's id is the number of words, its count 0."""
        ids = np.full(len(hashes), self.m.n_words, np.int64)
        run, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        part = (hashes >> np.uint64(64 - self.m.bits)).astype(np.int64) if self.m.bits else np.zeros(len(hashes), np.int64)
        for p in np.unique(part):
            n = int(self.m.sizes[p])
            if not n:
                continue
            mine = slice(*np.searchsorted(part, [p, p + 1]))
            a = self._part("words", int(p))
            at = np.minimum(np.searchsorted(a[:n], hashes[mine]), n - 1)
            known, base = a[at] == hashes[mine], self.before[p]
            cum = a[n + at].astype(np.int64), a[n + 1 + at].astype(np.int64)
            ids[mine] = np.where(known, self.first[p] + at, self.m.n_words)
            run[mine], count[mine] = base + cum[0], np.where(known, cum[1] - cum[0], 0)
        return ids, run, count

    def preceded(self, ids: np.ndarray) -> np.ndarray:
        """Continuation counts of ids, 0 for unknown words; those of known words come in order."""
        out, known = np.zeros(len(ids), np.int64), np.flatnonzero(ids < self.m.n_words)
        ends = np.searchsorted(ids[known], self.first)
        for p in np.flatnonzero(ends[1:] > ends[:-1]):
            mine = known[ends[p]:ends[p + 1]]
            out[mine] = self._part("follows", int(p))[ids[mine] - self.first[p]].astype(np.int64)
        return out

    def owner(self, place: int) -> int:
        """The running count of the context that holds ``place``."""
        if place >= self.m.n_tokens:
            return self.m.n_tokens
        p = int(np.searchsorted(self.before, place, "right")) - 1
        n = int(self.m.sizes[p])
        cum = self._part("words", p)[n:2 * n + 1]
        return int(self.before[p]) + int(cum[np.searchsorted(cum, np.uint64(place - self.before[p]), "right") - 1])


def _bigrams(words: _Words, tokens: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of each token of a chunk: the places of its own word and of the one before it (-1 after the begin mark) among
    the chunk's words; and those words' ids, running counts and counts."""
    flat = np.concatenate(tokens)
    unique, w = np.unique(flat, return_inverse=True)
    ids, run, count = words.find(unique)
    v = np.concatenate([[-1], w[:-1]])
    v[np.cumsum([0, *map(len, tokens[:-1])])] = -1
    return w, v, ids, run, count


def _route(m: Model, w, v, ids, run, count) -> tuple[np.ndarray, np.ndarray]:
    """(shard, key) of bigrams whose first word is known or the begin mark."""
    at = np.where(v < 0, m.n_tokens, run[v])
    own = np.where(v < 0, m.starts, count[v])
    share = np.floor(own * (ids[w] / (m.n_words + 1))).astype(np.int64)
    shard = (at + share) // m.mass
    place = np.maximum(at - shard * m.mass, -1) + 1  # 0: a context that begins in an earlier shard
    return shard, (place.astype(np.uint64) << np.uint64(_W_BITS)) | ids[w].astype(np.uint64)


# -- training ---------------------------------------------------------------------------------------------

def _vocabulary(docs: DataFrame, base: str, config: LmConfig) -> Model:
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = int(np.ceil(np.log2(min(4096, max(1, (size[0] or 0) / config.part_bytes)))))

    def count(batches):
        for _, _, tokens in _chunked(batches, config):
            keys, counts = np.unique(np.concatenate(tokens), return_counts=True)
            part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            ends = np.searchsorted(part, np.arange((1 << bits) + 1))
            rows = [(p, _pack_sorted(keys[s:e]), _pack(counts[s:e].astype(np.int64)))
                    for p, (s, e) in enumerate(zip(ends[:-1], ends[1:])) if e > s]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                             ["part", "keys", "counts"])

    def merge(batches):
        for part, rows in _grouped(batches, "part"):
            m = _Merge()
            for r in rows:
                m.add(_unpack_sorted(r["keys"]), _unpack(r["counts"], np.int64))
            keys, counts = m.done()
            path = _store(base, [keys, np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(keys)], pa.int64()),
                                              pa.array([int(counts.sum())], pa.int64())], ["part", "path", "n", "mass"])

    pieces = docs.select("text").mapInArrow(count, "part int, keys binary, counts binary")
    found = written(_together(pieces, "part").mapInArrow(merge, "part int, path string, n long, mass long"), "lm-words").collect()
    model = Model(bits, np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), starts=size[1])
    for r in found:
        model.sizes[r["part"]], model.masses[r["part"]], model.words[r["part"]] = r["n"], r["mass"], r["path"]
    total = model.n_tokens + model.starts
    model.mass = max(1, min(max(config.shard_mass, total // 4096), 1 << 26))
    if model.n_words >= 1 << _W_BITS:
        raise ValueError(f"the vocabulary has {model.n_words} words; keys have room for {1 << _W_BITS}")
    return model


def _kinds(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; fixed ones where those say nothing."""
    n = (n1, n2, n3, n4)
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return d if all(0 <= x <= k for x, k in zip(d, (1, 2, 3))) else (0.5, 1.0, 1.5)


def _contexts(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (place, c, n1, n2, n3) of a shard's contexts, in order."""
    place = (keys >> np.uint64(_W_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros((0, 5), np.int64)
    sums = [np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2)]
    return np.stack([place[first], *sums], axis=1)


def train(docs: DataFrame, config: LmConfig = LmConfig()) -> Model:
    """Learn from the texts of ``docs``."""
    spark = docs.sparkSession
    base = shared_folder(spark, "lm-model")
    docs = docs.select(F.col("text").cast("binary").alias("text"))
    model = _vocabulary(docs, base, config)
    ends = np.concatenate([[0], np.cumsum(model.sizes)]).astype(np.int64)

    def count(batches):
        words = _Words(model)
        for _, _, tokens in _chunked(batches, config):
            w, v, ids, run, own = _bigrams(words, tokens)
            shard, key = _route(model, w, v, ids, run, own)
            order = np.lexsort((key, shard))
            shard, key = shard[order], key[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])]))
            times = np.diff(np.append(new, len(key)))
            shard, key = shard[new], key[new]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
            for s, e in zip(cuts[:-1], cuts[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([shard[s]], pa.int64()), pa.array([_pack_sorted(key[s:e])], pa.binary()), pa.array(
                    [_pack(times[s:e].astype(np.int64))], pa.binary())], ["shard", "keys", "counts"])

    def merge(batches):
        words = _Words(model)
        for shard, rows in _grouped(batches, "shard"):
            m = _Merge()
            for r in rows:
                m.add(_unpack_sorted(r["keys"]), _unpack(r["counts"], np.int64))
            keys, counts = m.done()
            ctx = _contexts(keys, counts)
            counted, stats = _narrow(counts), _narrow(ctx.T)
            path = _store(base, [keys, stats, counted])
            edges = []
            for row in ctx[[0, -1]][:min(2, len(ctx))]:
                start = words.owner(shard * model.mass) if row[0] == 0 else shard * model.mass + int(row[0]) - 1
                edges += [start, *map(int, row[1:])]
            out = [("shard", shard, path, [len(keys), len(ctx), counted.itemsize, stats.itemsize, *_kinds(counts), *edges], None, None)]
            second, n = np.unique(keys & np.uint64((1 << _W_BITS) - 1), return_counts=True)
            cuts = np.searchsorted(second.astype(np.int64), ends)
            for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
                mine = slice(cuts[p], cuts[p + 1])
                out.append(("part", int(p), None, None, _pack_sorted(second[mine] - np.uint64(ends[p])), _pack(n[mine].astype(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (
                pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary()))], names)

    def preceding(batches):
        for p, rows in _grouped(batches, "id"):
            a = np.zeros(int(model.sizes[p]), np.int64)  # of words before a word, below the number of words
            for r in rows:
                a[_unpack_sorted(r["keys"]).astype(np.int64)] += _unpack(r["counts"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([_store(base, [_narrow(a)])]), pa.array(
                [[*_kinds(a), int((a > 2).sum())]], pa.list_(pa.int64()))], ["id", "path", "numbers"])

    names = ["kind", "id", "path", "numbers", "keys", "counts"]
    pieces = docs.mapInArrow(count, "shard long, keys binary, counts binary")
    out = written(_together(pieces, "shard").mapInArrow(
        merge, "kind string, id long, path string, numbers array<long>, keys binary, counts binary"), "lm-bigrams")
    kinds, split = np.zeros(4, np.int64), {}
    for r in out.where("kind = 'shard'").select("id", "path", "numbers").collect():
        n, m, wide, wide_stats, *rest = r["numbers"]
        model.shards[r["id"]] = (r["path"], n, m, wide, wide_stats)
        model.bigrams += n
        kinds += rest[:4]
        edges = {rest[i]: rest[i + 1:i + 5] for i in range(4, len(rest), 5)}
        for start, numbers in edges.items():
            split[start] = [a + b for a, b in zip(split.get(start, [0] * 4), numbers)]
    model.split = np.array([[s, *x] for s, x in sorted(split.items())], np.int64).reshape(-1, 5)
    model.discounts = discounts(*map(int, kinds))
    low = np.zeros(5, np.int64)
    follows = _together(out.where("kind = 'part'").select("id", "keys", "counts"), "id").mapInArrow(
        preceding, "id long, path string, numbers array<long>")
    for r in written(follows, "lm-follows").collect():
        model.follows[r["id"]] = r["path"]
        low += r["numbers"]
    model.low = discounts(*map(int, low[:4]))
    model.kinds = (int(low[0]), int(low[1]), int(low[4]))
    return model


# -- scoring ----------------------------------------------------------------------------------------------

def _cut(counts: np.ndarray, d: tuple) -> np.ndarray:
    """Counts less their discounts."""
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def _unigram(m: Model, preceded: np.ndarray) -> np.ndarray:
    if not m.bigrams:
        return np.full(len(preceded), 1.0 / (m.n_words + 1))
    rest = sum(d * k for d, k in zip(m.low, m.kinds)) / (m.n_words + 1)
    return (_cut(preceded, m.low) + rest) / m.bigrams


class _Shard:
    def __init__(self, model: Model, shard: int, words: _Words):
        self.m, self.shard, self.words = model, shard, words
        path, n, c, wide, wide_stats = model.shards.get(shard, (None, 0, 0, 4, 4))
        a = _mapped(path) if path else np.zeros(0, np.uint8)
        at = 8 * n + 5 * c * wide_stats
        self.keys, self.counts = a[:8 * n].view(np.uint64), a[at:].view(f"u{wide}")
        self.ctx = a[8 * n:at].view(f"u{wide_stats}").reshape(5, c)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted keys, repeats included."""
        m = self.m
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        k = keys[new]
        count = np.zeros(len(k), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            count = np.where(self.keys[at] == k, self.counts[at], 0).astype(np.int64)
        place = (k >> np.uint64(_W_BITS)).astype(np.int64)
        stats = np.zeros((4, len(k)), np.int64)
        if self.ctx.shape[1]:
            at = np.minimum(np.searchsorted(self.ctx[0], place.astype(self.ctx.dtype)), self.ctx.shape[1] - 1)
            stats = np.where(self.ctx[0][at].astype(np.int64) == place, self.ctx[1:, at].astype(np.int64), 0)
        if len(m.split):  # contexts at the shards' edges go by what all shards have of them
            start = self.shard * m.mass + place - 1
            if (place == 0).any():
                start[place == 0] = self.words.owner(self.shard * m.mass)
            at = np.minimum(np.searchsorted(m.split[:, 0], start), len(m.split) - 1)
            stats = np.where(m.split[at, 0] == start, m.split[at, 1:].T, stats)
        ids, back = np.unique((k & np.uint64((1 << _W_BITS) - 1)).astype(np.int64), return_inverse=True)
        low = _unigram(m, self.words.preceded(ids))[back]
        rest = sum(d * s for d, s in zip(m.discounts, stats[1:]))
        return np.repeat(np.log10((_cut(count, m.discounts) + rest * low) / stats[0]), np.diff(np.append(new, len(keys))))


def score(model: Model, docs: DataFrame, config: LmConfig = LmConfig()) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: one row per row of ``docs`` (doc_id, text).

    base_score is the add-one unigram score, score the model's log10 probability of the whole text.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select(F.col("text").cast("binary").alias("text"), "doc_id")

    def batch(rows, id_type):
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(id_type))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    def send(batches):
        """A row (chunk, -1 - chunk, packed numbers, -, ids) for each chunk, and its (chunk, shard, keys, docs) for each shard."""
        words = _Words(model)
        for chunk, rows, tokens in _chunked(batches, config):
            w, v, ids, run, count = _bigrams(words, tokens)
            doc = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(tokens))
            base = np.log10((count + 1) / (model.n_tokens + model.n_words + 1))
            lost = (v >= 0) & (count[v] == 0) if model.bigrams else np.ones(len(v), bool)
            local = np.where(lost, np.log10(_unigram(model, words.preceded(ids)))[w], 0.0)
            told = np.concatenate([per_doc(np.ones(len(w))), per_doc(count[w] > 0), per_doc(base[w]), per_doc(local)])
            out = [(chunk, -1 - chunk, _pack(told), None, [r[0] for r in rows])]
            keep = np.flatnonzero(~lost)
            shard, key = _route(model, w[keep], v[keep], ids, run, count)
            order = np.lexsort((key, shard))
            shard, key, doc = shard[order], key[order], doc[keep][order]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard)) if len(shard) else [0]
            for s, e in zip(cuts[:-1], cuts[1:]):
                out.append((chunk, int(shard[s]), _pack_sorted(key[s:e]), _pack(doc[s:e].astype(np.uint32)), None))
            for r in out:
                yield batch([r], kind_of)

    def look_up(batches):
        words, now, lists = _Words(model), None, None
        for b in batches:
            for r in b.to_pylist():
                if r["shard"] < 0:
                    yield batch([tuple(r[n] for n in names)], kind_of)
                    continue
                if now != r["shard"]:
                    now, lists = r["shard"], _Shard(model, r["shard"], words)
                doc = _unpack(r["docs"], np.uint32)
                some, back = np.unique(doc, return_inverse=True)
                sums = np.bincount(back, weights=lists.log10(_unpack_sorted(r["keys"])))
                yield batch([(r["chunk"], now, _pack(sums), _pack(some), None)], kind_of)

    def add_up(batches):
        for _, rows in _grouped(batches, "chunk"):
            first = next(rows)  # the chunk's own row, for its shard is below 0
            n, known, base, total = _unpack(first["keys"], np.float64).reshape(4, -1).copy()
            for r in rows:
                total[_unpack(r["docs"], np.uint32)] += _unpack(r["keys"], np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(first["ids"], kind_of), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
                                              pa.array(base), pa.array(total)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    names = ["chunk", "shard", "keys", "docs", "ids"]
    kind_of = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = f"chunk long, shard long, keys binary, docs binary, ids array<{kind}>"
    found = _together(docs.mapInArrow(send, schema), "shard").mapInArrow(look_up, schema)
    return _together(found, "chunk", "shard").mapInArrow(
        add_up, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def score_held_out(docs: DataFrame, config: LmConfig = LmConfig()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, by a model of the rows that
    aren't held out."""
    model = train(docs.where(in_training()), config)
    return score(model, docs, config).select(
        "doc_id", (~in_training()).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
