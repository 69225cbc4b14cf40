"""N-gram Jaccard join: sets of word shingles, linked at a similarity threshold, and their connected components.

A size-aware heavy-light join over distinct sets (equal sets are one node from the start):

* light sets, up to a size chosen by cost, enumerate the fixed-size subsets that a partner must share: two sets
  of sizes a and b link iff they share c(a, b) = ceil(t (a + b) / (1 + t)) shingles, so each set lists its
  subsets of each size c that its possible partners ask for, and sets that meet in one link without a check;
* heavy sets scan inverted lists of the first shingles of each set in one global order: |S| - ceil(t |S|) + 1
  shingles are enough for two linked sets to meet.  The order puts shingles of long lists last (a bounded
  set, the longest lists of the corpus) and is by hash otherwise.

Within a list no pairs are emitted at first: each member is checked against the list's hub, verified links
become components, and only members that lie outside the component with most of the list are then compared
with the list's members of other components; in long lists each such pair is made once, in the first list that
it shares, and only if the two prefixes, and bit signatures of the whole sets, leave room for enough common
shingles.  So a group of thousands of
near copies costs a star and its stragglers, yet every pair that could still join two components is verified
against the whole sets.

The boundary compares, per set size, the number of subsets with the number of list entries read.

Defined results: null, empty and wordless texts have no shingles, are linked with nothing, and are their own
component; rows with a null id take part but name no component (null if all are null); equal rows and
repeated ids give a row each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, keys, let, settled, written


@dataclass(frozen=True)
class JaccardConfig:
    words: int = 3
    percent: int = 90  # sets link when 100 * |A & B| >= percent * |A | B|
    light_limit: int = 24  # the cost comparison tries boundaries up to this set size
    long_list: int = 16  # shorter lists never count as long
    star_turns: int = 1  # rounds in which the long lists' stragglers meet members of the largest component
    draws: int = 6  # members that each list draws for that
    max_long: int = 1_000_000  # at most so many shingles are put last (8 bytes each in the broadcast)
    signature: int = 64  # words of 64 bits that stand for a set when stragglers of long lists are compared

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def shared(self, a: int, b: int) -> int:
        return -(-self.percent * (a + b) // (100 + self.percent))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; bytes' lower() and split() know ASCII only, as asked."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    with np.errstate(over="ignore"):
        s = np.full(n, np.uint64(len(found) if len(found) < words else words))
        for k in range(min(words, len(h))):
            s = _mix(s + h[k:k + n])
    return np.unique(s)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))


def _chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts stay near ``limit`` bytes."""
    for batch in batches:
        sizes, start, total = batch.column(column), 0, 0
        lengths = np.nan_to_num(pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False))
        for i, n in enumerate(lengths):
            total += n
            if total >= limit:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def shingle_rows(docs: DataFrame, config: JaccardConfig) -> DataFrame:
    """row columns of ``docs`` (doc_id, tkey) plus n, node (a content address of the set) and head.

    head holds the lowest hashes: half as many again as the prefix needs, or all of a small set.
    """
    def run(batches):
        for b in _chunks(batches, "text"):
            sets = [shingle_set(t, config.words) for t in b.column("text").to_pylist()]
            heads = [s if len(s) <= config.light_limit else s[:3 * config.prefix(len(s)) // 2 + 2] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tkey"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 _lists(heads)], ["doc_id", "tkey", "n", "node", "head"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.md5("text").alias("tkey")).mapInArrow(
        run, f"doc_id {kind}, tkey string, n long, node binary, head array<long>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(nid, text) of the wanted (nid, tkey), once per text."""
    found = docs.select(F.md5("text").alias("tkey"), "text").join(keys(wanted, "jaccard-wanted"), "tkey")
    return found.groupBy("nid").agg(F.first("text").alias("text"))


def _whole_sets(docs: DataFrame, wanted: DataFrame, config: JaccardConfig) -> DataFrame:
    """(nid, hashes) of the wanted (nid, tkey), shingled from the texts again, once per text."""
    def run(batches):
        for b in _chunks(batches, "text"):
            sets = [shingle_set(t, config.words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("nid"), _lists(sets)], ["nid", "hashes"])

    return _texts(docs, wanted).mapInArrow(run, "nid long, hashes array<long>")


def _signature(s: np.ndarray, words: int) -> np.ndarray:
    """A bit for each remainder that occurs among the hashes.

    Each bit of A that B lacks is a shingle of A that B lacks, so |A & B| <= |A| - (bits of A without B).
    """
    out = np.zeros(words, np.uint64)
    bit = s % np.uint64(64 * words)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _signatures(docs: DataFrame, wanted: DataFrame, config: JaccardConfig) -> DataFrame:
    """(nid, sig) of the wanted (nid, tkey), from the whole texts."""
    def run(batches):
        for b in _chunks(batches, "text"):
            sets = [_signature(shingle_set(t, config.words), config.signature) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("nid"), _lists(sets)], ["nid", "sig"])

    return _texts(docs, wanted).mapInArrow(run, "nid long, sig array<long>")


def _long_lists(nodes: DataFrame, config: JaccardConfig) -> np.ndarray:
    """The shingles of the longest lists, at most ``max_long`` of them, sorted."""
    length = nodes.where(F.col("n") > config.light_limit).select(F.explode("head").alias("h")).groupBy("h").count() \
        .where(F.col("count") >= config.long_list)
    length = written(length, "jaccard-long")
    sizes = length.groupBy(F.floor(F.log2("count")).cast("int").alias("b")).count().orderBy(F.desc("b")).collect()  # at most 64 rows
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > config.max_long:
            break
        least = r["b"]
    if least is None:
        return np.zeros(0, np.uint64)
    rows = length.where(F.floor(F.log2("count")) >= least).select("h").toPandas()["h"]
    return np.sort(rows.to_numpy(np.int64).view(np.uint64))


def _in_order(s: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that don't go last, and those that do."""
    if not len(last):
        return s, s[:0]
    at = np.searchsorted(last, s)
    late = last[np.minimum(at, len(last) - 1)] == s
    return s[~late], s[late]


def _prefixes(docs: DataFrame, nodes: DataFrame, last: np.ndarray, boundary: int, config: JaccardConfig) -> DataFrame:
    """(nid, n, prefix) of each set that can have a partner beyond the boundary."""
    def emit(nids, sizes, sets, whole):
        for nid, n, s in zip(nids, sizes, sets):
            p = config.prefix(n)
            early, late = _in_order(s, last)
            if len(early) >= p:
                yield nid, n, early[:p]
            elif whole or len(s) == n:
                yield nid, n, np.concatenate([early, late])[:p]
            else:
                yield nid, n, s[:0]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           _lists([r[2] for r in rows])], ["nid", "n", "prefix"])

    def from_heads(batches):
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                x = b.slice(start, 2000)
                heads = [np.asarray(h.values.to_numpy(), np.int64).view(np.uint64) for h in x.column("head")]
                yield batch_of(list(emit(x.column("nid").to_pylist(), x.column("n").to_pylist(), heads, False)))

    def from_texts(batches):
        for b in _chunks(batches, "text"):
            sets = [shingle_set(t, config.words) for t in b.column("text").to_pylist()]
            yield batch_of(list(emit(b.column("nid").to_pylist(), map(len, sets), sets, True)))

    large = nodes.where(100 * F.col("n") >= config.percent * (boundary + 1)).select("nid", "n", "tkey", "head")
    schema = "nid long, n long, prefix array<long>"
    first = written(large.select("nid", "n", "head").mapInArrow(from_heads, schema), "jaccard-prefix")
    short = first.where(F.size("prefix") == 0).select("nid").join(large.select("nid", "tkey"), "nid")
    rest = written(_texts(docs, short).mapInArrow(from_texts, schema), "jaccard-prefix")
    return first.where(F.size("prefix") > 0).union(rest)


def _boundary(nodes: DataFrame, config: JaccardConfig) -> int:
    """The set size up to which listing subsets costs less than reading lists."""
    light = {r["n"]: r["rows"] for r in nodes.where(F.col("n") <= config.light_limit).groupBy("n").agg(
        F.count("*").alias("rows")).collect()}
    best, least = 0, None
    for x in range(config.light_limit + 1):
        cost = 0
        for n, rows in light.items():
            subsets = sum(comb(n, c) for c in _subset_sizes(n, x, config)) if n <= x else 0
            lists = 2 * config.prefix(n) if 100 * n >= config.percent * (x + 1) else 0  # an entry is written and read
            cost += rows * (subsets + lists)
        if least is None or cost <= least:
            best, least = x, cost
    return best


def _subset_sizes(n: int, boundary: int, config: JaccardConfig) -> list[int]:
    """Sizes of shared subsets that sets of n may need with a partner of up to ``boundary``, itself not counted."""
    partners = [b for b in range(1, boundary + 1) if 100 * min(n, b) >= config.percent * max(n, b)]
    return sorted({c for b in partners if (c := config.shared(n, b)) <= min(n, b) and (b != n or c < n)})


def _light_links(nodes: DataFrame, boundary: int, config: JaccardConfig) -> DataFrame:
    """Links (a, b) among sets of up to ``boundary`` shingles, as stars around the smallest set of each shared subset.

    If two sets that share a c-subset link, then each links with any smaller set that shares it, as c(a, b)
    grows with both sizes; so the star has the same components as all links.
    """
    sizes = {n: c for n in range(1, boundary + 1) if (c := _subset_sizes(n, boundary, config))}

    def run(batches):
        for b in batches:
            rows = ([], [], [], [])
            for nid, n, head in zip(b.column("nid").to_pylist(), b.column("n").to_pylist(), b.column("head")):
                s = np.asarray(head.values.to_numpy(), np.int64).view(np.uint64)
                with np.errstate(over="ignore"):
                    one, two = _mix(s + np.uint64(1)), _mix(s + np.uint64(2))
                    for c in sizes[n]:
                        drop = np.array(list(combinations(range(n), n - c)), np.int64).reshape(-1, n - c)
                        rows[0].append((one.sum() - one[drop].sum(axis=1, dtype=np.uint64)).view(np.int64))
                        rows[1].append((two.sum() - two[drop].sum(axis=1, dtype=np.uint64)).view(np.int64))
                        rows[2].append(np.full(len(drop), c, np.int64))
                        rows[3].append(np.full(len(drop), nid, np.int64))
                if sum(map(len, rows[0])) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r)) for r in rows], ["k1", "k2", "c", "nid"])
                    rows = ([], [], [], [])
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r)) for r in rows], ["k1", "k2", "c", "nid"])

    light = nodes.where(F.col("n").isin(list(sizes) or [-1])).select("nid", "n", "head")
    key = ["k1", "k2", "c"]
    subsets = light.mapInArrow(run, "k1 long, k2 long, c long, nid long").join(light.select("nid", "n"), "nid")
    hubs = subsets.groupBy(*key).agg(F.count("*").alias("m"), F.min(F.struct("n", "nid")).alias("hub")).where("m > 1").drop("m")
    total = config.percent * (F.col("n") + F.col("hub.n"))
    return subsets.join(hubs, key).where((F.col("nid") != F.col("hub.nid")) & (F.col("c") * (100 + config.percent) >= total)) \
        .select(F.col("hub.nid").alias("a"), F.col("nid").alias("b")).distinct()


def _plausible(pairs: DataFrame, config: JaccardConfig) -> DataFrame:
    """(a, b) whose sizes and last common prefix place leave room for enough common shingles.

    ``pairs``: a, na, pa, b, nb, pb, a row for each common prefix shingle that was seen, and its places; before
    the last of them there may be others.
    """
    got = pairs.groupBy("a", "b").agg(F.max("pa").alias("pa"), F.max("pb").alias("pb"),
                                      F.max("na").alias("na"), F.max("nb").alias("nb"))
    room = 1 + F.least("pa", "pb") + F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    return got.where((100 * F.least("na", "nb") >= config.percent * F.greatest("na", "nb"))
                     & ((100 + config.percent) * room >= config.percent * (F.col("na") + F.col("nb")))).select("a", "b")


def _overlap_bound(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> int:
    """At most so many shingles are common, given the lowest hashes of both sets; exact for whole sets."""
    upto = min(x[-1] if len(x) < nx else np.uint64(2**64 - 1), y[-1] if len(y) < ny else np.uint64(2**64 - 1))
    x, y = x[:np.searchsorted(x, upto, "right")], y[:np.searchsorted(y, upto, "right")]
    return len(np.intersect1d(x, y, assume_unique=True)) + min(nx - len(x), ny - len(y))


def _pairs_where(pairs: DataFrame, sets: DataFrame, config: JaccardConfig) -> DataFrame:
    """(a, b, linked): whether the overlap bound of the sets (nid, n, hashes; whole or lowest) reaches the threshold."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                b = batch.slice(start, 1000)
                ok = []
                for x, y, nx, ny in zip(b.column("sa"), b.column("sb"), b.column("na").to_pylist(), b.column("nb").to_pylist()):
                    x, y = (np.asarray(v.values.to_numpy(), np.int64).view(np.uint64) for v in (x, y))
                    common = _overlap_bound(x, y, nx, ny)
                    ok.append(100 * common >= config.percent * (nx + ny - common))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    both = pairs.join(sets.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("sb")), "b") \
        .join(sets.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("sa")), "a")
    return both.mapInArrow(run, "a long, b long, linked boolean")


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, config: JaccardConfig) -> DataFrame:
    """(a, b, linked): first by a bound from the heads, then, for those that pass, by the whole sets."""
    def members(of: DataFrame) -> DataFrame:
        return of.select(F.col("a").alias("nid")).union(of.select("b")).distinct()

    def step() -> DataFrame:
        some = written(pairs, "jaccard-pairs")
        heads = nodes.join(keys(members(some), "jaccard-wanted"), "nid").select("nid", "n", F.col("head").alias("hashes"))
        first = written(_pairs_where(some, written(heads, "jaccard-heads"), config), "jaccard-bound")
        near = first.where("linked").select("a", "b")
        wanted = nodes.select("nid", "tkey").join(keys(members(near), "jaccard-wanted"), "nid")
        sets = written(_whole_sets(docs, wanted, config).withColumn("n", F.size("hashes").cast("long")), "jaccard-sets")
        return _pairs_where(near, sets, config).union(first.where("not linked"))

    return settled(docs.sparkSession, "jaccard-verified", step)


def _heavy_links(docs: DataFrame, nodes: DataFrame, links: DataFrame, boundary: int, config: JaccardConfig) -> DataFrame:
    """``links`` plus links (a, b) that make the components of all sets right."""
    last = _long_lists(nodes, config)
    prefixes = _prefixes(docs, nodes, last, boundary, config)
    entries = prefixes.select("nid", "n", F.posexplode("prefix").alias("pos", "h"))
    lists = entries.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    entries = written(entries.join(lists, "h"), "jaccard-lists")
    beyond = (F.col("na") > boundary) | (F.col("nb") > boundary)
    alike = 100 * F.least("na", "nb") >= config.percent * F.greatest("na", "nb")

    def side(x: str, of: DataFrame, *more: str) -> DataFrame:
        return of.select("h", F.col("nid").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), *more)

    def drawn(of: DataFrame, seeds: Iterable[int]) -> DataFrame:
        """For each seed, one member of each list, another one in each list; a member that is drawn again counts once."""
        least = [F.min(F.struct(F.xxhash64("h", "nid", F.lit(s)).alias("draw"), "nid", "n", "pos")) for s in seeds]
        members = F.array_distinct(F.transform(F.array(*least), lambda x: x.dropFields("draw")))
        return of.groupBy("h").agg(members.alias("members")).select("h", F.inline("members"))

    def stars(members: DataFrame, hubs: DataFrame) -> DataFrame:
        pairs = side("b", members).join(side("a", hubs), "h").where((F.col("a") != F.col("b")) & beyond & alike)
        return _plausible(_ordered(pairs), config)

    def components(links: DataFrame) -> DataFrame:
        """(a, b): each node of ``links`` and its component's root; these links stand for all."""
        comp = written(connected_components(links), "jaccard-components")
        return comp.select(F.col("node").alias("a"), F.col("root").alias("b"))

    def rooted(comp: DataFrame, of: DataFrame) -> DataFrame:
        """The entries of lists with more than one component, with their component and the list's largest."""
        own = of.join(comp.select(F.col("a").alias("nid"), F.col("b").alias("root")), "nid", "left") \
            .withColumn("root", F.coalesce("root", "nid"))
        main = own.groupBy("h", "root").agg(F.count("*").alias("k")).groupBy("h").agg(
            F.max(F.struct("k", "root")).alias("main"), F.count("*").alias("roots"))
        return written(own.join(main.where("roots > 1").select("h", F.col("main.root").alias("main")), "h"), "jaccard-split")

    # stars: each list's members against one of them; then, in long lists, those outside the largest
    # component against a few of its members
    done = _verify(docs, nodes, stars(entries, drawn(entries, [0])), config)
    links = components(links.union(done.where("linked").select("a", "b")))
    for turn in range(config.star_turns):
        now = rooted(links, entries.where(F.col("m") > config.long_list))
        first = 1 + turn * config.draws
        hubs = drawn(now.where("root = main"), range(first, first + config.draws))
        pairs = stars(now.where("root <> main"), hubs).join(done.select("a", "b"), ["a", "b"], "left_anti")
        checked = _verify(docs, nodes, pairs, config)
        done = done.union(checked)
        links = components(links.union(checked.where("linked").select("a", "b")))

    # the rest: members outside their list's largest component, against the list's other components
    now = rooted(links, entries)
    ra, rb = F.col("root").alias("ra"), F.col("root").alias("rb")
    apart = (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))) & beyond & alike

    def compared(of: DataFrame, *more: str) -> DataFrame:
        left = side("a", of.where("root <> main"), ra, "main", *[F.col(c).alias(f"{c}_a") for c in more])
        return left.join(side("b", of, rb, *[F.col(c).alias(f"{c}_b") for c in more]), "h").where(apart)

    short = _plausible(_ordered(compared(now.where(F.col("m") <= config.long_list))), config)
    # in long lists, members carry their prefixes, so that each pair is made in its first common list alone
    long_ = now.where(F.col("m") > config.long_list)
    members = keys(long_.select("nid").distinct(), "jaccard-long-members")
    signs = written(_signatures(docs, nodes.select("nid", "tkey").join(members, "nid"), config), "jaccard-signatures")
    long_ = long_.join(prefixes.join(members, "nid").select("nid", "prefix").join(signs, "nid"), "nid")

    def room(c):  # the common ones, and what can follow the last of them in either set
        tail = F.element_at(c, -1)
        return F.size(c) + F.least(F.col("na") - F.array_position("prefix_a", tail), F.col("nb") - F.array_position("prefix_b", tail))

    # nothing before the first common place is common
    early = (100 + config.percent) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) \
        >= config.percent * (F.col("na") + F.col("nb"))
    hopeful = early & let(F.array_intersect("prefix_a", "prefix_b"), lambda c: (F.element_at(c, 1) == F.col("h")) & (
        (100 + config.percent) * room(c) >= config.percent * (F.col("na") + F.col("nb"))))
    # bits that one set has and the other lacks are shingles that it lacks
    def enough(own: str, other: str):
        lacking = F.aggregate(F.zip_with(f"sig_{own}", f"sig_{other}", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))),
                              F.lit(0), lambda n, x: n + x)
        return (100 + config.percent) * (F.col(f"n{own}") - lacking) >= config.percent * (F.col("na") + F.col("nb"))

    far = compared(long_, "prefix", "sig").where(hopeful & enough("a", "b") & enough("b", "a"))
    rest = short.union(far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    checked = _verify(docs, nodes, rest.join(done.select("a", "b"), ["a", "b"], "left_anti"), config)
    return links.union(checked.where("linked").select("a", "b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    flip = F.col("a") < F.col("b")
    return pairs.select(*[F.when(flip, F.col(x + u)).otherwise(F.col(x + v)).alias(x + u)
                          for x in ("", "n", "p") for u, v in (("a", "b"), ("b", "a"))])


def link_documents(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> tuple[DataFrame, DataFrame]:
    """(rows, members): doc_id, tkey, n, node for every row, and node, root, component_id for every distinct set."""
    docs = docs.select("doc_id", "text")
    rows = written(shingle_rows(docs, config).withColumn("nid", F.monotonically_increasing_id()), "jaccard-rows")
    reps = written(rows.where("n > 0").groupBy("node").agg(F.min("nid").alias("nid"), F.min("doc_id").alias("doc_id")),
                   "jaccard-nodes")
    nodes = rows.select("nid", "n", "tkey", "head").join(keys(reps.select("nid"), "jaccard-reps"), "nid")
    boundary = _boundary(nodes, config)
    links = written(_light_links(nodes, boundary, config), "jaccard-links")
    links = written(_heavy_links(docs, nodes, links, boundary, config), "jaccard-links")
    comp = written(connected_components(links), "jaccard-components")
    members = reps.join(comp.withColumnRenamed("node", "nid"), "nid", "left") \
        .withColumn("root", F.coalesce("root", "nid"))
    least = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.select("doc_id", "tkey", "n", "node"), written(members.select("node", "root").join(least, "root"), "jaccard-members")


def jaccard_components(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    rows, members = link_documents(docs, config)
    return rows.join(members, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """The rows of ``docs`` without their near duplicates: of each component the row with its smallest id stays.

    Rows without shingles and rows of components without any id stay, one for each different text; of rows with
    the same id and text, one stays.  Columns are as in ``docs``.
    """
    rows, members = link_documents(docs, config)
    keep = rows.join(members, "node", "left").where(
        (F.col("n") == 0) | F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    text = F.coalesce("tkey", F.lit("-"))
    # one row for each kept group: of the rows with the id that stays, that with the smallest text key
    group = F.coalesce(F.concat(F.lit("c"), F.col("component_id").cast("string")),
                       F.concat(F.lit("r"), F.col("root").cast("string")),
                       F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text))
    chosen = keep.groupBy(group.alias("g")).agg(F.min(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("d"),
                                                               text.alias("t"))).alias("x")).select("x.*").distinct()
    chosen = written(chosen, "jaccard-keep")
    d, t = fresh(docs.columns, "keep_id"), fresh(docs.columns, "keep_text")
    out = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), t: F.coalesce(F.md5("text"), F.lit("-"))})
    out = out.join(chosen.select(F.col("d").alias(d), F.col("t").alias(t)), [d, t])
    return out.dropDuplicates([d, t]).select(*docs.columns)
