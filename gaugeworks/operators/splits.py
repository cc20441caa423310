"""Apportionment and train/validation/test splits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CLASS_NAMES, SPLITS
from .dedup import hash_links
from .graph import components
from .ordered import ranked, ranked_within

RATIOS = (0.70, 0.15, 0.15)


def checked_ratios(ratios) -> None:
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"ratios must add up to 1: {ratios}")


def apportioned(n: int, ratios=RATIOS) -> list[int]:
    """Whole shares of n by largest remainder, the earlier of equal remainders first.

    From three on, each of the first three shares gets one if the largest of them can spare it.
    """
    import numpy as np

    exact = n * np.asarray(ratios, np.float64)
    floor = np.floor(exact).astype(np.int64)
    place = np.empty(len(exact), np.int64)  # of each remainder, from the largest
    place[np.argsort(-(exact - floor), kind="stable")] = np.arange(len(exact))
    shares = floor + (place < n - floor.sum())
    first = shares[:3]
    if n >= 3 and (empty := int((first == 0).sum())) and first.max() > empty:
        first[first.argmax()] -= empty
        first[first == 0] = 1
    return shares.tolist()


def percent_cuts(n: int) -> tuple[int, int]:
    """70 and 15 percent in whole numbers; the rest is the test set."""
    return n * 70 // 100, n * 15 // 100


def shuffled_key(seed: int, key: Column) -> Column:
    """An order that depends on the seed and the key only."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def plain_split(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """70/15/15 of the whole set in seeded order: key and split."""
    train, val = percent_cuts(rows.count())
    r = F.col("rank")
    return ranked(rows.select(key), [shuffled_key(seed, F.col(key)), F.col(key)]).select(key, F.when(r <= train, SPLITS[0]).when(r <= train + val, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))


def stratified_split(rows: DataFrame, key: str, stratum: str, seed: int = 42) -> DataFrame:
    """70/15/15 of each stratum in seeded order: key, stratum, split. A stratum may hold most rows: ranks come from ranges."""
    r, train, val = F.col("rank"), F.expr("_n * 70 div 100"), F.expr("_n * 15 div 100")
    at = ranked_within(rows.select(key, stratum), [stratum], [shuffled_key(seed, F.col(key)), F.col(key)])
    return at.select(key, stratum, F.when(r <= train, SPLITS[0]).when(r <= train + val, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))


def near_clusters(files: DataFrame, key: str = "id", h: str = "dhash", distance: int = 6) -> DataFrame:
    """key and cluster: the smallest key reachable through hashes within the distance; no hash: a cluster of its own."""
    least = files.where(F.col(h).isNotNull()).groupBy(h).agg(F.min(key).alias("least"))
    roots = components(hash_links(least.select(F.col(h).alias("h")), distance))
    joined = roots.join(least, roots["node"] == least[h])
    smallest = joined.groupBy("root").agg(F.min("least").alias("cluster"))
    linked = joined.join(smallest, "root").select(F.col("node").alias(h), "cluster")
    named = least.join(linked, h, "left").select(h, F.coalesce("cluster", "least").alias("cluster"))
    return files.select(key, h).join(named, h, "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def cluster_split(clusters: DataFrame, key: str = "id", seed: int = 42, ratios=RATIOS) -> DataFrame:
    """Whole clusters in seeded order go to the splits; members inherit: key, cluster, split."""
    checked_ratios(ratios)
    names = clusters.select("cluster").distinct()
    train, val, _ = apportioned(names.count(), list(ratios))
    r = F.col("rank")
    sides = ranked(names, [shuffled_key(seed, F.col("cluster")), F.col("cluster")]).select("cluster", F.when(r <= train, SPLITS[0]).when(r <= train + val, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))
    return clusters.select(key, "cluster").join(sides, "cluster")


# Fixed values of the balanced plan: its seed, sizes, and the weight of a class (BASE + most seen - seen, at least FLOOR).
PLAN_SEED, PLAN_IMAGES, PLAN_PER_CLASS, PLAN_STEP, PLAN_MOST = 20261008, 700, 100, 20, 4000
PLAN_BASE, PLAN_FLOOR, PLAN_CLASSES_OF_AN_IMAGE = 4.0, 0.35, (1, 3)


def plan_rows(seed: int = PLAN_SEED, n_classes: int = len(CLASS_NAMES)) -> Iterator[tuple[int, ...]]:
    """Distinct classes of one image after the other, without end; classes seen less often are likelier.

    Each draw depends on all earlier ones, so this is a sequence and not a table.
    """
    import numpy as np

    draw = np.random.default_rng(seed)
    low, high = PLAN_CLASSES_OF_AN_IMAGE
    tally = np.zeros(n_classes)
    while True:
        wanted = draw.integers(low, high + 1)
        weight = (PLAN_BASE + tally.max() - tally).clip(PLAN_FLOOR)
        taken: tuple[int, ...] = ()
        for _ in range(wanted):
            share = np.where(np.isin(np.arange(n_classes), taken), 0.0, weight)
            taken += (int(draw.choice(n_classes, p=share / share.sum())),)
        tally[list(taken)] += 1
        yield taken


def balanced_plan(seed: int = PLAN_SEED, least_images: int = PLAN_IMAGES, least_per_class: int = PLAN_PER_CLASS, n_classes: int = len(CLASS_NAMES), most: int = PLAN_MOST):
    """(class lists, counts by class): the shortest plan of a multiple of PLAN_STEP images that meets both minimums."""
    import numpy as np

    plan = list(islice(plan_rows(seed, n_classes), most + 1))
    counts = np.cumsum([np.bincount(row, minlength=n_classes) for row in plan], axis=0)
    size = np.arange(1, len(plan) + 1)
    fits = (size >= least_images) & (counts.min(axis=1) >= least_per_class) & (size % PLAN_STEP == 0)
    if not fits.any():
        raise RuntimeError(f"no balance within {most} images: {counts[-1].tolist()}")
    end = int(fits.argmax())
    return [list(row) for row in plan[: end + 1]], counts[end]


def planned(spark: SparkSession, prefix: int | None = None, **plan) -> DataFrame:
    """The balanced plan as a table: number, seed of the image, class_ids; prefix: only the first so many images."""
    rows, _ = balanced_plan(**plan)
    seed = plan.get("seed", PLAN_SEED)
    return spark.createDataFrame([(i, seed + i, ids) for i, ids in enumerate(rows[:prefix])], "number long, seed long, class_ids array<int>")
