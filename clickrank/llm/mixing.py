"""Mixing sources to target weights: hierarchical token budgets over a domain / language / source tree.

1. Tokens per leaf, one grouped aggregate; a node's capacity is its tokens times ``max_epochs``.
   Leaves below a weight of 0 count as 0.
2. Top down, each node's budget is poured over its children in proportion to their weights.  A child that
   can't take its share is filled, and the rest goes to its siblings first; only what no sibling can take
   reaches the next level up (as the parent's own capacity is the sum of its children's).  The children
   sort by capacity per weight, so one ordered window per parent finds the filled ones.
3. A leaf takes whole epochs of its rows and the prefix of one more.  Each epoch has its own seeded order
   (a hash of seed, epoch and id).  The prefix ends at a cut hash: token sums per (leaf, hash bucket) find the
   bucket in which it ends, and only that bucket's rows are ranked, so no task orders a whole leaf.
   A row is then selected by comparing its own hash with its leaf's cut.

Budgets are integers, shares round down, so the result does not depend on partitioning.  No Python runs
on the executors.

Defined results: a null language, source or domain is the leaf 'unknown'; a row without words has no tokens and
is never selected; rows without an id go by a hash of their text; rows of one leaf with the same id, or with none and
the same text, tie, and are taken or left together; the prefix is the longest that fits; very long texts are counted
whole; an empty table gives no rows; weights that are missing count 1, a weight of 0 takes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, text_or_empty, words_of, written

LEVELS = ("domain", "language", "source")
#: Leaf tables of up to this many rows are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_LEAVES = 50_000
#: Hex digits of the hash that name a bucket.
BUCKET_DIGITS = 3


def default_domain() -> Column:
    """Four domains, dealt from the number at the end of the source's name."""
    number = F.regexp_extract(F.col("source"), r"([0-9]+)$", 1)
    return F.when(number != "", F.element_at(F.array(*map(F.lit, ("web", "reference", "books", "forums"))),
                                             (F.pmod(number.try_cast("decimal(38,0)"), F.lit(4)) + 1).cast("int")))


@dataclass(frozen=True)
class MixConfig:
    """Integer weights by node name at each level; ``target_tokens`` or a share (per thousand) of the corpus."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 4, "reference": 3, "books": 2, "forums": 1})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    target_tokens: int | None = None
    target_permille: int = 600
    max_epochs: int = 4
    seed: int = 42


def _weight(name: str, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("decimal(38,0)")
    table = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.col(name)), F.lit(1)).cast("decimal(38,0)")


def _long(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _pour(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``budget`` to children that carry cap, weight and the parent's budget ``above``."""
    order = Window.partitionBy(*parent).orderBy(F.try_divide(F.col("cap").cast("double"), F.col("weight").cast("double")).asc_nulls_first(), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = _long(F.col("above") - F.coalesce(F.sum("taken").over(before), F.lit(0)))
    nodes = nodes.withColumn("taken", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0).cast("decimal(38,0)")))
    nodes = nodes.withColumn("left", left).withColumn("rest", _long(F.sum("weight").over(after)))
    nodes = nodes.withColumn("filled", (F.col("cap") * F.col("rest") <= F.col("left") * F.col("weight")) & (F.col("weight") > 0))
    # of the children that aren't filled, the first tells what is left for all of them
    first = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pot = F.first(F.when(~F.col("filled") & (F.col("weight") > 0), F.struct("left", "rest")), ignorenulls=True).over(first)
    nodes = nodes.withColumn("pot", pot)
    share = F.floor(F.try_divide(F.col("pot.left") * F.col("weight"), F.col("pot.rest")))
    return nodes.withColumn("budget", _long(F.when(F.col("weight") <= 0, F.lit(0)).when(F.col("pot").isNull(), F.col("cap"))
                                            .otherwise(share))).drop("taken", "left", "rest", "filled", "pot")


def leaf_budgets(leaves: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """domain, language, source, tokens, budget, epochs, rest from (domain, language, source, tokens)."""
    # a leaf below a weight of 0 takes nothing, so it adds nothing to the capacity of the nodes above it
    open_ = F.least(*[_weight(level, weights) for level, weights in zip(LEVELS, (config.domains, config.languages, config.sources))]) > 0
    leaves = leaves.withColumn("cap", _long(F.when(open_, F.col("tokens") * config.max_epochs).otherwise(0)))
    total = leaves.agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap"))
    target = F.lit(config.target_tokens) if config.target_tokens is not None else F.expr(
        f"cast(tokens as decimal(38,0)) * {config.target_permille} div 1000")
    above = total.select(_long(F.least(_long(target), F.col("cap"))).alias("above"))
    path: list[str] = []
    for level, weights in zip(LEVELS, (config.domains, config.languages, config.sources)):
        nodes = leaves.groupBy(*path, level).agg(_long(F.sum("cap")).alias("cap")).withColumn("weight", _weight(level, weights))
        nodes = nodes.join(above, path) if path else nodes.crossJoin(above)  # the total is one row
        above = _pour(nodes, path, level).select(*path, level, F.col("budget").alias("above"))
        path.append(level)
    out = leaves.join(above, path).select(*path, "tokens", F.col("above").cast("long").alias("budget"))
    return out.withColumn("epochs", F.expr("budget div tokens")) \
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def _row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(text_or_empty())))


def _order(epoch: Column, seed: int, row_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), row_id))


def _leaf_columns(domain: Column) -> list[Column]:
    unknown = F.lit("unknown")
    return [F.coalesce(domain, unknown).alias("domain"), F.coalesce(F.col("lang"), unknown).alias("language"),
            F.coalesce(F.col("source"), unknown).alias("source")]


def leaf_plan(docs: DataFrame, config: MixConfig = MixConfig(), domain: Column | None = None) -> DataFrame:
    """One row per leaf: its budget, whole epochs, and the hash at which the last epoch's prefix is cut."""
    domain = default_domain() if domain is None else domain
    path = list(LEVELS)
    rows = docs.select(_row_id().alias("row_id"), *_leaf_columns(domain), F.size(words_of(text_or_empty())).cast("long").alias("n"))
    rows = written(rows.where("n > 0"), "mix-rows")
    leaves = written(rows.groupBy(*path).agg(F.sum("n").alias("tokens")), "mix-leaves")
    plan = written(leaf_budgets(leaves, config), "mix-budgets")
    small = plan.count() <= MAX_BROADCAST_LEAVES
    part = plan.where("rest > 0").select(*path, "epochs", "rest")
    ranked = rows.join(F.broadcast(part) if small else part, path).withColumn("h", _order(F.col("epochs"), config.seed, F.col("row_id")))
    ranked = ranked.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    upto = Window.partitionBy(*path).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranked.groupBy(*path, "bucket").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.max("h").alias("last"))
    sums = sums.withColumn("to", F.sum("n").over(upto))  # at most 16 ** BUCKET_DIGITS rows for a leaf
    sums = written(sums, "mix-buckets")
    whole = sums.where("to <= rest").groupBy(*path).agg(F.max("last").alias("cut"))
    ends = sums.where("to > rest and to - n <= rest").groupBy(*path).agg(
        F.min("bucket").alias("bucket"), F.min(F.col("to") - F.col("n")).alias("before"))
    ends = F.broadcast(ends) if small else ends
    run = Window.partitionBy(*path).orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranked.join(ends, [*path, "bucket"]).withColumn("to", F.col("before") + F.sum("n").over(run)) \
        .where("to <= rest").groupBy(*path).agg(F.max("h").alias("cut"))
    cut = whole.union(inside).groupBy(*path).agg(F.max("cut").alias("cut"))
    return written(plan.join(cut, path, "left"), "mix-plan")


def mix(docs: DataFrame, config: MixConfig = MixConfig(), domain: Column | None = None) -> DataFrame:
    """``docs`` as selected: a row for each epoch that takes it, with the columns of ``docs`` plus epoch, domain, n_tokens.

    If ``docs`` has a column of one of these names, the new one's name gets underscores.
    """
    plan = leaf_plan(docs, config, domain)
    domain = default_domain() if domain is None else domain
    taken = list(docs.columns)
    leaf = [fresh(taken, f"mix_{c}") for c in LEVELS]
    n, epoch, name = (fresh(taken, c) for c in ("n_tokens", "epoch", "domain"))
    own = plan.select(*[F.col(c).alias(a) for c, a in zip(LEVELS, leaf)],
                      *[F.col(c).alias(fresh(taken, f"mix_{c}")) for c in ("epochs", "cut")])
    epochs, cut = own.columns[-2:]
    small = plan.count() <= MAX_BROADCAST_LEAVES
    rows = docs.withColumns({a: c for a, c in zip(leaf, _leaf_columns(domain))})
    rows = rows.withColumn(n, F.size(words_of(text_or_empty())).cast("long")).where(F.col(n) > 0)
    rows = rows.join(F.broadcast(own) if small else own, leaf)
    last = F.when(_order(F.col(epochs), config.seed, _row_id()) <= F.col(cut), F.col(epochs)).otherwise(F.col(epochs) - 1)
    return rows.withColumn(epoch, F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)))) \
        .select(*taken, F.col(epoch), F.col(leaf[0]).alias(name), F.col(n))
