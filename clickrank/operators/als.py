"""Implicit ALS recommender (M3, M4, J6, J8, L3) on Spark ML."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.operators.blocktopk import masked_top_k
from clickrank.operators.reclist import RecList

ALS_SEED = 42  # fixed value: the reference seeds every fit with 42


@dataclass(frozen=True)
class ALSSettings:
    """What a fit depends on.

    The random start of the factors depends on the number of blocks, so it is a
    setting (Spark's own default) and is never taken from the cores at hand.
    """

    rank: int
    regParam: float
    alpha: float
    maxIter: int
    implicitPrefs: bool = True
    nonnegative: bool = True
    coldStartStrategy: str = "drop"
    numUserBlocks: int = 10
    numItemBlocks: int = 10


def fit_grid(train: DataFrame, grid: list[ALSSettings]) -> list[ALSModel]:
    """M3, M5: one model for each setting, on (visitorid, itemid, score)."""
    estimator = ALS(userCol="visitorid", itemCol="itemid", ratingCol="score", seed=ALS_SEED)
    maps = [{estimator.getParam(name): value for name, value in asdict(settings).items()} for settings in grid]
    return estimator.fit(train.select("visitorid", "itemid", "score"), maps)


def recommend_from_model(model: ALSModel, train: DataFrame, users: DataFrame, k: int,
                         exclude_seen: bool = True) -> RecList:
    """L3 + J6 + J8: the best k unseen items of each known user, in one scoring pass (see ``masked_top_k``).

    Users unknown to the model get no list.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    known = model.userFactors.select(F.col("id").alias("visitorid"), "features").join(
        users.select("visitorid").distinct(), "visitorid", "left_semi")
    items = model.itemFactors.select(F.col("id").alias("itemid"), "features")
    best = masked_top_k(known, items, train if exclude_seen else None, k)
    return RecList(best.select("visitorid", "rank", "itemid"), known.select("visitorid"))


def gram(factors: DataFrame, rank: int) -> list[list[float]]:
    """The sum of the outer products of all factors, ``rank`` by ``rank`` numbers from one aggregate."""
    x = F.transform("features", lambda v: v.cast("double"))
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    row = factors.select(x.alias("x")).agg(*[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return [[row[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(rank)] for i in range(rank)]


def user_optimality(model: ALSModel, train: DataFrame, settings: ALSSettings) -> DataFrame:
    """(visitorid, residual): how far each user's factors are from the optimum for the fitted item factors.

    With the item factors y held fixed, an implicit non-negative fit has for each user the least of
    x'Ax/2 - b'x over x >= 0, where A = Y'Y + sum(c y y') + reg n I, b = sum((1 + c) y), c = alpha * score, over the
    user's n items.  At the optimum, the gradient g = Ax - b is 0 where x > 0 and not below 0 elsewhere, so the residual
    is the largest |min(x, g / A_jj)| relative to the largest x.  A x is never built from A: each pair adds
    (c (y.x) - 1 - c) y to its user's gradient, a grouped sum with partial sums, however many items a user has.
    """
    rank = settings.rank
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    y = model.itemFactors.select(F.col("id").alias("itemid"), F.col("features").alias("y"))
    x = model.userFactors.select(F.col("id").alias("visitorid"), F.col("features").alias("x"))
    c = F.lit(settings.alpha) * F.col("score").cast("float").cast("double")
    pairs = train.select("visitorid", "itemid", "score").join(y, "itemid").join(x, "visitorid")
    pull = c * dot(F.col("y"), F.col("x")) - 1.0 - c
    sums = pairs.withColumn("pull", pull).withColumn("c", c).groupBy("visitorid").agg(
        F.count(F.lit(1)).alias("n"), F.first("x").alias("x"),
        *[F.sum(F.col("pull") * F.col("y")[j]).alias(f"g{j}") for j in range(rank)],
        *[F.sum(F.col("c") * F.col("y")[j] * F.col("y")[j]).alias(f"a{j}") for j in range(rank)])
    total = gram(model.itemFactors, rank)
    reg = F.lit(settings.regParam) * F.col("n")

    def off(j: int):
        own = F.col("x")[j].cast("double")
        g = F.col(f"g{j}") + reg * own
        for i in range(rank):
            g = g + F.lit(total[j][i]) * F.col("x")[i]
        return F.abs(F.least(own, g / (F.col(f"a{j}") + F.lit(total[j][j]) + reg)))

    residual = F.greatest(*[off(j) for j in range(rank)], F.lit(0.0)) / F.greatest(F.array_max("x").cast("double"), F.lit(1e-30))
    return sums.select("visitorid", residual.alias("residual"))


def recommend_als(train: DataFrame, users: DataFrame, k: int, rank: int, reg_param: float, alpha: float,
                  max_iter: int, exclude_seen: bool = True, **settings) -> tuple[RecList, ALSModel]:
    """M4: fit (``settings``: more of ALSSettings), then recommend for ``users``."""
    model, = fit_grid(train, [ALSSettings(rank, reg_param, alpha, max_iter, **settings)])
    return recommend_from_model(model, train, users, k, exclude_seen), model
