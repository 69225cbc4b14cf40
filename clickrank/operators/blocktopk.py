"""Masked block top-k: the best k items of each user by the product of factors, without the items it has seen.

Users are dealt into blocks by hash.  The items go to every block by descending norm, and a user has done with them
when no product with what is left can reach its k-th best: |x| |y| bounds x.y, so nothing is lost, and a user meets few
of the items.  A list needs no over-fetch, however long its user's history is, and is whole when its block is.

Shuffled are the users' factors and each seen pair once, and the items' once for each user block.  A worker holds the
users of a block with what they have seen (four bytes a pair, so many users that these are a few million pairs) and
their lists so far, a block of items, and the products of some tens of users.  Products are summed in double precision and rounded to float, ties go to the smaller item id, so
lists don't depend on how the blocks are cut.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

USER, SEEN, ITEM = 0, 1, 2  # the order in which a block's rows come
LIST_ENTRIES = 4_000_000  # places of all lists that a worker holds
SLACK = 1 + 1e-6  # a product rounded to float may exceed its bound by less


@dataclass(frozen=True)
class BlockSize:
    users: int = 262_144
    items: int = 16_384
    step: int = 64  # users multiplied at a time
    pairs: int = 8_000_000  # seen by the users of a block, about


def top_of_block(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k highest finite scores of each row, ties to the lower column, best first."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    value = scores[row, col]
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    start = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - start[row] < k
    return row[keep], col[keep], value[keep]


class Seen:
    """What the users ``ids`` (ascending) have seen, at four bytes a pair; a user's pairs come together, in the users' order.

    Only copies are kept, as a view would hold the whole batch that it is of.
    """

    def __init__(self, ids: np.ndarray):
        self.ids, self.n, self.items = ids, np.zeros(len(ids), np.int64), []

    def add(self, held: np.ndarray, masked: np.ndarray) -> None:
        row = np.minimum(np.searchsorted(self.ids, held), len(self.ids) - 1)
        known = self.ids[row] == held
        np.add.at(self.n, row[known], 1)
        self.items.append(masked[known])

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """(the items of all users end to end, where each user's begin, and the end)."""
        items, self.items = np.concatenate(self.items) if self.items else np.zeros(0, np.int32), []
        return items, np.concatenate([[0], np.cumsum(self.n)])


class Lists:
    """The lists so far of a block's users: ``ids`` ascending, ``x`` their factors, ``held`` and ``masked`` the pairs seen,
    or ``seen`` instead."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, held: np.ndarray, masked: np.ndarray, k: int, step: int, seen: Seen | None = None):
        self.ids, self.x, self.k, self.step = ids, x, k, step
        if seen is None:
            seen, order = Seen(ids), np.argsort(held, kind="stable")
            seen.add(held[order], masked[order])
        self.masked, self.first = seen.taken()
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        self.score = np.full((len(ids), k), -np.inf, np.float32)
        self.item = np.zeros((len(ids), k), np.int32)

    def add(self, items: np.ndarray, y: np.ndarray) -> int:
        """Takes in a block of items; returns the number of products.  The k-th best of a user only rises."""
        order = np.argsort(items, kind="stable")
        items, y = items[order], y[order]
        top = np.sqrt((y * y).sum(axis=1).max())
        live = np.flatnonzero(self.norm * top * SLACK >= self.score[:, -1])
        for s in range(0, len(live), self.step):
            self._merge(live[s:s + self.step], items, y)
        return len(live) * len(items)

    def _merge(self, at: np.ndarray, items: np.ndarray, y: np.ndarray) -> None:
        scores = (self.x[at].astype(np.float64) @ y.T).astype(np.float32)
        n = self.first[at + 1] - self.first[at]
        row = np.repeat(np.arange(len(at)), n)
        seen = self.masked[np.arange(len(row)) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)]
        place = np.minimum(np.searchsorted(items, seen), len(items) - 1)
        here = items[place] == seen
        scores[row[here], place[here]] = -np.inf
        least = self.score[at, -1]
        if np.isinf(least).any():
            row, col, value = top_of_block(scores, self.k)
        else:
            row, col = np.nonzero(scores >= least[:, None])
            value = scores[row, col]
        old, pos = np.nonzero(self.score[at] > -np.inf)
        row, item = np.concatenate([old, row]), np.concatenate([self.item[at[old], pos], items[col]])
        value = np.concatenate([self.score[at[old], pos], value])
        order = np.lexsort((item, -value, row))
        row, item, value = row[order], item[order], value[order]
        pos = np.arange(len(row)) - np.searchsorted(row, row)
        keep = pos < self.k
        self.score[at[row[keep]], pos[keep]], self.item[at[row[keep]], pos[keep]] = value[keep], item[keep]


def masked_top_k(users: DataFrame, items: DataFrame, seen: DataFrame | None, k: int, size: BlockSize = BlockSize()) -> DataFrame:
    """(visitorid, rank, itemid, rating): ``users`` (visitorid, features), ``items`` (itemid, features), one row for each
    id; ``seen`` holds (visitorid, itemid) pairs, repeated or not, of any users and items."""
    n_users, spark = users.count(), users.sparkSession
    # a task or two for each core, if the users are enough for that: the items are copied to every block
    wanted = min(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_seen = seen.count() if seen is not None else 0
    blocks = max(1, -(-n_users // max(1, min(size.users, LIST_ENTRIES // k))), min(-(-n_seen // size.pairs), n_users), min(wanted, n_users // 1024))
    own = F.pmod(F.xxhash64("visitorid"), F.lit(blocks)).cast("int").alias("ub")
    none, number = F.lit(None).cast("array<float>"), F.lit(None).cast("int")
    norm = F.aggregate("features", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = items.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("ub"), F.lit(ITEM).alias("kind"), norm.alias("norm"),
                        number.alias("visitorid"), "itemid", "features")
    rows = rows.union(users.select(own, F.lit(USER).alias("kind"), F.lit(0.0).alias("norm"), "visitorid", number.alias("itemid"), "features"))
    if seen is not None:
        rows = rows.union(seen.where("visitorid is not null and itemid is not null").select(
            own, F.lit(SEEN).alias("kind"), F.lit(0.0).alias("norm"), "visitorid", "itemid", none.alias("features")))

    def runs(batches):
        """(block, kind, slice of a batch) in the order of the sorted rows."""
        for b in batches:
            ub, kind = (b.column(c).to_numpy() for c in ("ub", "kind"))
            new = np.flatnonzero((np.diff(ub) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *new], [*new, b.num_rows]):
                if e > s:
                    yield int(ub[s]), int(kind[s]), b.slice(s, e - s)

    def matrix(b, kind=np.float64):
        return b.column("features").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1)

    none_held = np.zeros(0, np.int32)

    def run(batches):
        for _, parts in groupby(runs(batches), key=lambda x: x[0]):
            ids, factors, pairs, waiting, lists = [], [], None, [], None
            for _, kind, b in parts:
                if kind == USER:
                    ids.append(b.column("visitorid").to_numpy().copy())
                    factors.append(matrix(b, np.float32))
                elif not ids:
                    continue
                elif kind == SEEN:
                    pairs = pairs or Seen(np.concatenate(ids))
                    pairs.add(b.column("visitorid").to_numpy(), b.column("itemid").to_numpy())
                else:
                    if lists is None:
                        pairs = pairs or Seen(np.concatenate(ids))
                        lists = Lists(pairs.ids, np.concatenate(factors), none_held, none_held, k, size.step, pairs)
                        factors = []
                    for s in range(0, b.num_rows, size.items):
                        waiting.append(b.slice(s, size.items))
                        if sum(x.num_rows for x in waiting) >= size.items:
                            lists.add(np.concatenate([x.column("itemid").to_numpy() for x in waiting]), np.concatenate([matrix(x) for x in waiting]))
                            waiting = []
            if waiting:
                lists.add(np.concatenate([x.column("itemid").to_numpy() for x in waiting]), np.concatenate([matrix(x) for x in waiting]))
            if lists is not None:
                for s in range(0, len(lists.ids), 10_000):
                    r, p = np.nonzero(lists.score[s:s + 10_000] > -np.inf)
                    r += s
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists.ids[r], pa.int32()), pa.array((p + 1).astype(np.int32)), pa.array(lists.item[r, p]), pa.array(lists.score[r, p])],
                        ["visitorid", "rank", "itemid", "rating"])

    dealt = rows.repartition(blocks, "ub").sortWithinPartitions("ub", "kind", F.desc("norm"), "visitorid", "itemid")
    return dealt.mapInArrow(run, "visitorid int, rank int, itemid int, rating float")
