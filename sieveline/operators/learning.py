"""Samples, similarities of vectors, zero-shot and few-shot classifiers, and examples of topics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import cosine


def draw(key: str, seed: int = 7) -> Column:
    """A hash of the key that any engine can compute: hexadecimal MD5 of key and seed."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """The n rows of the smallest hashes of the key: the same at every run and partitioning."""
    return df.orderBy(draw(key, seed), key).limit(n)


def in_share(key: str, share: float, seed: int = 7) -> Column:
    """True for about this share of the keys, always the same ones; needs no shuffle."""
    return F.substr(draw(key, seed), F.lit(1), F.lit(8)) < f"{round(share * 16**8) - 1:08x}"


def split_at(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """``df`` with ``part``: train for the n rows of ``sample``, test for the others; only the last hash of the sample is joined."""
    last = sample(df.select(key), key, n, seed).agg(F.max(F.struct(draw(key, seed).alias("h"), F.col(key).alias("k"))).alias("_last"))
    own = F.struct(draw(key, seed).alias("h"), F.col(key).alias("k"))
    return df.join(F.broadcast(last), how="inner").withColumn("part", F.when(own <= F.col("_last"), "train").otherwise("test")).drop("_last")


def class_cosines(df: DataFrame, label: str, vec: str) -> DataFrame:
    """(a, b, similarity): cosine of the mean vectors of each two classes, from per-component sums; classes are few."""
    parts = df.where(F.col(label).isNotNull()).select(label, F.posexplode(vec).alias("pos", "v"))
    mean = parts.groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    norm = mean.groupBy(label).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    mean = mean.join(norm, label).select(label, "pos", F.try_divide("v", "n").alias("v"))
    other = mean.select(F.col(label).alias("b"), "pos", F.col("v").alias("w"))
    x = mean.withColumnRenamed(label, "a").join(other, "pos").where("a <= b")
    return x.groupBy("a", "b").agg(F.round(F.sum(F.col("v") * F.col("w")), 6).alias("similarity"))


def zero_shot(df: DataFrame, examples: DataFrame, vec: str) -> DataFrame:
    """``df`` with ``positive``: whether its nearest example (columns vec, positive: a few written ones) is a positive one."""
    sides = examples.agg(F.collect_list(F.when(F.col("positive"), F.col(vec))).alias("_yes"), F.collect_list(F.when(~F.col("positive"), F.col(vec))).alias("_no"))
    near = lambda side: F.array_max(F.transform(side, lambda e: cosine(F.col(vec), e)))
    scored = df.join(F.broadcast(sides), how="inner").withColumns({"_near": near("_yes"), "_far": near("_no")})
    return scored.withColumn("positive", F.col("_near") > F.col("_far")).drop("_yes", "_no", "_near", "_far")


def few_shot(df: DataFrame, train: DataFrame, vec: str, truth: str, c: float = 100.0) -> DataFrame:
    """``df`` with ``predicted`` and ``probability`` of a logistic regression on the few labelled rows of ``train``."""
    ready = lambda x: x.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>"))).withColumn("_y", F.col(truth).cast("double"))
    labelled = ready(train).cache()
    model = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=1 / (c * max(1, labelled.count())), maxIter=100).fit(labelled)
    labelled.unpersist()
    model.setPredictionCol("_predicted").setProbabilityCol("_p").setRawPredictionCol("")
    out = model.transform(ready(df))
    return out.withColumn("predicted", F.col("_predicted") == 1).withColumn("probability", vector_to_array("_p")[1]).drop("_v", "_y", "_predicted", "_p")


#: Vectors of which all pairs are compared at most; beyond, a search for the nearest is the way.
MOST_ITEMS, ITEMS_A_BLOCK = 20_000, 1000


def pairwise_cosines(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(a, b, similarity) for each two rows with a <= b of a bounded set: the matrix of normalised vectors times itself.

    Rows are dealt into blocks, and each two blocks meet in one group, where a dense product gives their pairs; nothing is
    joined with everything. Vectors that are null, zero or hold null or non-finite components, and rows without a key, have no pairs.
    """
    usable = F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = df.where(F.col(key).isNotNull() & usable).select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    n = rows.limit(MOST_ITEMS + 1).count()
    if n > MOST_ITEMS:
        raise ValueError(f"over {MOST_ITEMS} vectors have too many pairs to list")
    blocks = max(1, -(-n // ITEMS_A_BLOCK))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("key", "vec", "own", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))

    def product(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        m = np.vstack(group["vec"].to_numpy())
        m /= np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        keys, left, right = group["key"].to_numpy(), (group["own"] == i).to_numpy(), (group["own"] == j).to_numpy()
        a, b = np.nonzero(np.triu(np.ones((left.sum(), right.sum()), bool)) if i == j else np.ones((left.sum(), right.sum()), bool))
        s = (m[left] @ m[right].T)[a, b]
        ka, kb = keys[left][a], keys[right][b]
        return pd.DataFrame({"a": np.where(ka <= kb, ka, kb), "b": np.where(ka <= kb, kb, ka), "similarity": s})

    kind = rows.schema["key"].dataType.simpleString()
    return dealt.groupBy("i", "j").applyInPandas(lambda g: product(g), f"a {kind}, b {kind}, similarity double").withColumn("similarity", F.round("similarity", 6))


def examples(df: DataFrame, topic: str, weight: str, key: str, n: int = 3) -> DataFrame:
    """The n rows of each topic in which it weighs most, ties by key."""
    w = Window.partitionBy(topic).orderBy(F.desc(weight), key)
    return df.where(F.col(topic).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
