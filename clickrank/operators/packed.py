"""Sums per (key, candidate) of arrays of candidates, in the task that holds the key.

A row per (key, candidate) would be shuffled at tens of bytes; an array takes four for each candidate.  Rows come
sorted by key, and a worker holds a few million candidates at a time and the sums of the key it is at, however many
rows a key has.  Hot keys are dealt over many tasks by a hash of the candidate.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.operators.skew import SALT

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Candidates summed at a time.
STEP = 2_000_000


def run_numbers(*columns: pa.Array) -> np.ndarray:
    """For each of the sorted rows, the number of its run of equal ones, from 0; nulls are equal."""
    new = np.zeros(len(columns[0]), bool)
    for x in columns:
        value, null = x.fill_null(0).to_numpy(zero_copy_only=False), x.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return np.cumsum(new)


def codes(run: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One number for each run and 32-bit value, in their order."""
    return (run.astype(np.int64) << 32) + (value.astype(np.int64) + 2**31)


def starts_of(code: np.ndarray) -> np.ndarray:
    """Where runs of equal ones begin in sorted codes."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))


def bits(x: np.ndarray) -> int:
    """The bits that the differences to the least value take."""
    return (int(x.max()) - int(x.min())).bit_length() if len(x) else 0


def summed(code: np.ndarray, amount: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and the sum of each one's amounts, or its count without amounts."""
    if amount is None:
        code = np.sort(code)
        first = starts_of(code)
        return code[first], np.diff(first, append=len(code))
    if not len(code):
        return code, amount
    width = int(amount.max()).bit_length()
    if amount.min() >= 0 and bits(code) + width <= 63:  # both sort as one number, which is several times faster than by index
        least = code.min()
        both = np.sort(((code - least) << width) | amount.astype(np.int64))
        code, amount = (both >> width) + least, both & ((1 << width) - 1)
    else:
        order = np.argsort(code, kind="stable")
        code, amount = code[order], amount[order]
    first = starts_of(code)
    return code[first], np.add.reduceat(amount, first)


def best_first(code: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The order of sorted codes by run, total desc, value."""
    run, place = code >> 32, len(code).bit_length()
    width = bits(total)
    if bits(run) + width + place > 63:
        return np.lexsort((code, -total, run))
    at = np.arange(len(code), dtype=np.int64)
    return np.sort(((run - run[:1]) << (width + place)) | ((total.max() - total).astype(np.int64) << place) | at) & ((1 << place) - 1)


def first_of_runs(code: np.ndarray, total: np.ndarray, own: np.ndarray, best: int | None) -> tuple[np.ndarray, ...]:
    """(run, value, total) of sorted codes, without those in ``own``; only the ``best`` of each run by total desc, value asc."""
    if len(own) and len(code):
        at = np.minimum(np.searchsorted(code, own), len(code) - 1)
        keep = np.ones(len(code), bool)
        keep[at[code[at] == own]] = False
        code, total = code[keep], total[keep]
    if best is not None and len(code):
        first = starts_of(code >> 32)  # the runs stay where they are
        place = np.arange(len(code)) - np.repeat(first, np.diff(first, append=len(code)))
        order = best_first(code, total)[place < best]
        code, total = code[order], total[order]
    return code >> 32, ((code & 0xFFFFFFFF) - 2**31).astype(np.int32), total.astype(np.int64)


def packed_sums(rows: DataFrame, key: str, candidate: str, total: str, hot: Sequence = (), best: int | None = None,
                step: int = STEP) -> DataFrame:
    """(key, candidate, total) of ``rows`` (key, own, candidates array, amounts array or null for ones), without the pairs
    of a key and one of its ``own``; candidates are 32-bit integers.

    ``best``: only as many pairs of each key, by total desc and candidate asc; of a hot key, as many of each of its parts.
    """
    types = dict(rows.dtypes)
    salts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select(key, F.col("own").cast("int"), F.col("candidates").cast("array<int>"), F.col("amounts").cast("array<bigint>"), F.lit(0).alias(SALT))
    if hot:
        is_hot = F.coalesce(F.col(key).isin(list(hot)), F.lit(False))
        part = lambda x: F.pmod(F.hash(x), F.lit(salts))
        mine = lambda x: part(x) == F.col(SALT)
        # each part gets its candidates, and its own item the part that could hold it
        parts = F.array_distinct(F.concat(F.transform("candidates", part), F.array(part(F.col("own")))))
        pairs = F.filter(F.arrays_zip("candidates", "amounts"), lambda p: mine(p["candidates"]))
        dealt = rows.where(is_hot).withColumn(SALT, F.explode(parts)).select(
            key, F.when(mine(F.col("own")), F.col("own")).alias("own"), F.filter("candidates", mine).alias("candidates"),
            F.when(F.col("amounts").isNotNull(), F.transform(pairs, lambda p: p["amounts"])).alias("amounts"), SALT)
        rows = rows.where(~is_hot).unionByName(dealt)

    def slices(batches):
        """Rows of about ``step`` candidates."""
        for b in batches:
            ends = np.cumsum(b.column("candidates").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < b.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + step, "right")))
                yield b.slice(start, end - start)
                start = end

    def run(batches):
        def out(names, code, amounts, own):
            at, value, sums = first_of_runs(code, amounts, own, best)
            if len(at):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(value), pa.array(sums)], [key, candidate, total])

        last = None  # the key that more rows may come of: (its name and part, codes, sums, own codes), all of run 0
        for b in slices(batches):
            runs = run_numbers(b.column(key), b.column(SALT))
            starts = np.flatnonzero(np.diff(runs, prepend=-1))
            names = b.column(key).take(pa.array(starts))
            lists, amounts, own = b.column("candidates"), b.column("amounts"), b.column("own")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            code = codes(np.repeat(runs, lengths), lists.flatten().to_numpy(zero_copy_only=False))
            amounts = amounts.flatten()
            code, sums = summed(code, amounts.to_numpy(zero_copy_only=False) if len(amounts) else None)
            named = own.is_valid().to_numpy(zero_copy_only=False)
            own = codes(runs[named], own.filter(pa.array(named)).to_numpy(zero_copy_only=False))
            if last is not None:
                if last[0] == (b.column(key)[0].as_py(), b.column(SALT)[0].as_py()):
                    code, sums = summed(np.concatenate([last[1], code]), np.concatenate([last[2], sums]))
                    own = np.concatenate([last[3], own])
                else:
                    yield from out(pa.array([last[0][0]], names.type), *last[1:])
            end, n = len(starts) - 1, b.num_rows
            cut = np.searchsorted(code, np.int64(end) << 32)
            of_last = own >> 32 == end
            yield from out(names, code[:cut], sums[:cut], own[~of_last])
            shift = np.int64(end) << 32
            last = (b.column(key)[n - 1].as_py(), b.column(SALT)[n - 1].as_py()), code[cut:] - shift, sums[cut:], np.unique(own[of_last] - shift)
        if last is not None:
            yield from out(pa.array([last[0][0]], names.type), *last[1:])

    # no null lists: the writer of a batch fills them in anew for every row that follows
    rows = rows.withColumn("amounts", F.coalesce("amounts", F.array().cast("array<bigint>")))
    dealt = rows.repartition(key, SALT).sortWithinPartitions(key, SALT)
    sums = dealt.mapInArrow(run, f"{key} {types[key]}, {candidate} int, {total} bigint")
    return sums.withColumn(candidate, F.col(candidate).cast(types["own"]))
