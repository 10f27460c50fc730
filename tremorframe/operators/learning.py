"""Preparation, training and scoring of classifiers for the structural system.

Splits, folds and synthetic rows derive from hashes of ids, so they don't depend on the
partitioning. Statistics are fitted inside a fold. Spark ML has no multi-class boosting or kernel machines: ``boosting`` is
one-vs-rest gradient-boosted trees and ``svc`` one-vs-rest linear machines, over squared features for degree 2.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str, seed: int = 0) -> Column:
    """A number in [0, 1) from a row's key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


# Cleaning ------------------------------------------------------------------------------------


def with_labels(df: DataFrame, label: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose label is known, and one row of counts (kept, removed)."""
    ok = F.coalesce(F.col(label).isin(values), F.lit(False))
    return df.where(ok), df.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("removed"))


def without_nulls(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without nulls, and how many rows each column removes after the ones before it."""
    seen, removed = F.lit(True), []
    for c in columns:
        removed.append(F.count_if(seen & F.col(c).isNull()).alias(c))
        seen = seen & F.col(c).isNotNull()
    return df.dropna(subset=columns), df.agg(*removed)


def larger_than(df: DataFrame, min_area: float, area: str = "area") -> DataFrame:
    return df.where(F.col(area) > min_area)


def violations(df: DataFrame, features: list[str], categories: dict[str, list[str]]) -> list[str]:
    """What breaks the contract: missing features, and values outside the declared categories."""
    out = [f"missing feature {c}" for c in features if c not in df.columns]
    present = {c: v for c, v in categories.items() if c in df.columns}
    if present:
        row = df.agg(*(F.collect_set(F.when(~F.col(c).isin(v), F.col(c))).alias(c) for c, v in present.items())).head()
        out += [f"{c} has undeclared {sorted(row[c])}" for c in present if row[c]]
    return out


def numeric(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``columns`` as doubles (null where a text is no number), and one row with the values each lost so."""
    lost = lambda c: F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull())
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns}), df.agg(*(lost(c).alias(c) for c in columns))


def only(df: DataFrame, columns: list[str], required: bool = True) -> DataFrame:
    """Some columns in order; those that ``df`` lacks are an error, or left out if not ``required``."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking and required:
        raise ValueError(f"missing columns {lacking}")
    return df.select(*(c for c in columns if c in df.columns))


def rare_labels(df: DataFrame, label: str, least: int = 5) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") < least)


# Splits ----------------------------------------------------------------------------------------


def places(df: DataFrame, key: str, strata: list[str], seed: int = 0) -> DataFrame:
    """Adds ``_k`` (place from 0 within the stratum, in order of the MD5 of "key:seed") and ``_n`` (rows of the stratum).

    Rows are counted by the hash's first three digits, so places come from windows over a 4,096th of a stratum. Rows without a key come last.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    rows = df.withColumn("_h", F.coalesce(h, F.lit("g"))).withColumn("_b", F.substring("_h", 1, 3))
    w = Window.partitionBy(*strata)
    ends = rows.groupBy(*strata, "_b").agg(F.count("*").alias("_m"))
    ends = ends.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)), F.col("_b").alias("_sb"), (F.sum("_m").over(w.orderBy("_b")) - F.col("_m")).alias("_under"), F.sum("_m").over(w).alias("_n"))
    same = F.col("_b") == F.col("_sb")
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    own = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", key))
    rows = rows.withColumn("_own", own).join(ends, same).withColumn("_k", F.col("_under") + F.col("_own") - 1)
    return rows.select(*df.columns, "_k", "_n")


def stratified_split(df: DataFrame, key: str, strata: list[str], shares: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """Adds ``split`` (train, val, test): per stratum the shares of rows in hash order; a stratum's only row trains."""
    # In decimals: 45 * 0.7 is 31.5 and rounds to 32, but falls short of it as doubles.
    first, second = (Decimal(str(s)) for s in shares[:2])
    train, val = F.round(F.col("_n") * F.lit(first)), F.round(F.col("_n") * F.lit(first + second))
    split = F.when((F.col("_n") == 1) | (F.col("_k") < train), "train").when(F.col("_k") < val, "val").otherwise("test")
    return places(df, key, strata, seed).withColumn("split", split).drop("_k", "_n")


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold`` 0..k-1, stratified by label."""
    return places(df, key, [label], seed).withColumn("fold", (F.col("_k") % k).cast("int")).drop("_k", "_n")


# Features ----------------------------------------------------------------------------------------


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): the largest class's count by each one's."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.max("n").over(Window.partitionBy(F.lit(1))) / F.col("n"))  # one row a class


def scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of columns."""
    row = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).head()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def scaled(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """z-scores; a constant column becomes 0."""
    return df.withColumns({c: (F.col(c) - m) / s if s else F.lit(0.0) for c, (m, s) in fitted.items()})


def one_hot(df: DataFrame, column: str, categories: list[str], drop_first: bool = False) -> DataFrame:
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in categories[int(drop_first) :]}).drop(column)


def ordinal(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(categories), F.array_position(F.array(*map(F.lit, categories)), F.col(column)) - 1).cast("int"))


def encode_labels(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """Codes in the order of the sorted classes."""
    return ordinal(df, label, sorted(classes))


def decode_labels(df: DataFrame, column: str, classes: list[str]) -> DataFrame:
    return df.withColumn(column, F.element_at(F.array(*map(F.lit, sorted(classes))), F.col(column).cast("int") + 1))


def smote(df: DataFrame, key: str, label: str, features: list[str], k: int = 5, seed: int = 0, block: int = 5000) -> DataFrame:
    """Rows of minority classes between a row and one of its k nearest of the class, so that classes are of equal size.

    Returns ``df`` (key, label, features) and the new rows (negative keys). Only rows that get copies, as many as the class lacks, ask for their
    nearest. They and the class are dealt into blocks of about ``block`` rows by hash; each block of asking rows meets every block of
    the class, and the best k merge, so the rows don't depend on the blocks.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    need = counts.withColumn("_need", F.max("_n").over(Window.partitionBy(F.lit(1))) - F.col("_n")).where("_need > 0")
    rows = df.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.array(*(F.col(c).cast("double") for c in features)).alias("_x"))
    rows = rows.join(F.broadcast(need.withColumnRenamed(label, "_label")), "_label")  # one row a class
    # Places in the order of a hash: within a bucket of it, after the rows of the buckets before (1,024 a class at most).
    rows = rows.withColumn("_h", F.pmod(F.xxhash64("_key", F.lit(seed + 1)), F.lit(1024)))
    before = rows.groupBy("_label", "_h").agg(F.count("*").alias("_m")).withColumn("_before", F.sum("_m").over(Window.partitionBy("_label").orderBy("_h")) - F.col("_m")).drop("_m")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_label", "_h").orderBy("_key")) - 1
    placed = rows.join(before, ["_label", "_h"]).withColumn("_copies", F.floor(F.col("_need") / F.col("_n")) + (place < F.col("_need") % F.col("_n")).cast("long")).where("_copies > 0")
    dealt = lambda n: F.pmod(F.xxhash64("_key", F.lit(seed)), n).cast("int")
    blocks, asking = F.ceil(F.col("_n") / block).cast("int"), F.ceil(F.least("_n", "_need") / block).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asks = placed.select("_label", "_key", "_x", F.lit(0).alias("_side"), dealt(asking).alias("_p"), every(blocks).alias("_q"))
    data = rows.select("_label", "_key", "_x", F.lit(1).alias("_side"), every(asking).alias("_p"), dealt(blocks).alias("_q"))
    types = dict(df.dtypes)

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame._side == 0], frame[frame._side == 1].sort_values("_key")
        out = []
        if len(a) and len(b):
            x, y, ids = np.stack(a._x.to_numpy()), np.stack(b._x.to_numpy()), b._key.to_numpy()
            step, squares = max(1, 4_000_000 // max(len(y), 1)), (y * y).sum(1)
            for at in range(0, len(x), step):
                part, own = x[at : at + step], a._key.to_numpy()[at : at + step]
                size = (part * part).sum(1)[:, None]
                rough = size + squares[None] - 2 * (part @ y.T)
                rough[own[:, None] == ids[None]] = np.inf
                # The k nearest are among those that rounding may place before the k-th; exact distances decide, then the smaller key.
                last = np.partition(rough, k - 1, 1)[:, k - 1 : k] if len(y) > k else np.full((len(part), 1), np.inf)
                last = np.where(np.isfinite(last), last + 1e-9 * (size + squares[np.isfinite(squares)].max(initial=0.0)), np.inf)
                i, j = np.nonzero(rough <= last)
                i, j = i[(real := np.isfinite(rough[i, j]))], j[real]
                d = np.concatenate([((part[i[c : c + 100_000]] - y[j[c : c + 100_000]]) ** 2).sum(-1) for c in range(0, max(len(i), 1), 100_000)])
                order = np.lexsort((j, d, i))
                i, j, d = i[order], j[order], d[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j, d = i[keep], j[keep], d[keep]
                out.append(pd.DataFrame({"_label": a._label.iloc[0], "_key": own[i], "_d": d, "_near": ids[j], "_y": list(y[j])}))
        return pd.concat(out)[lambda f: np.isfinite(f._d)] if out else pd.DataFrame(columns=["_label", "_key", "_d", "_near", "_y"])

    pairs = asks.unionByName(data).groupBy("_label", "_p", "_q").applyInPandas(near, f"_label {types[label]}, _key {types[key]}, _d double, _near {types[key]}, _y array<double>")
    best = pairs.groupBy("_label", "_key").agg(F.slice(F.array_sort(F.collect_list(F.struct("_d", "_near", "_y"))), 1, k).alias("_best"))
    new = placed.join(best, ["_label", "_key"]).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    random = lambda s: F.pmod(F.xxhash64("_key", "_i", F.lit(seed), F.lit(s)), F.lit(1 << 40)) / float(1 << 40)
    new = new.withColumn("_y", F.element_at("_best", (F.floor(random(1) * F.size("_best")) + 1).cast("int"))["_y"]).withColumn("_t", random(2))
    values = {c: (F.col("_x")[j] + F.col("_t") * (F.col("_y")[j] - F.col("_x")[j])).cast(types[c]) for j, c in enumerate(features)}
    values |= {key: (-1 - (F.col("_key") * 1000 + F.col("_i"))).cast(types[key]), label: F.col("_label")}
    names = [key, label, *features]
    return df.select(*names).unionByName(new.select(*(values[c].alias(c) for c in names)))


# Models --------------------------------------------------------------------------------------------


def logistic(c: float = 1.0, **kw):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(maxIter=100, **kw)  # ``fit`` sets the penalty from c and the rows


def forest(max_depth: int = 8, trees: int = 50, **kw):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(maxDepth=max_depth, numTrees=trees, seed=42, **kw)


def boosting(max_depth: int = 3, rounds: int = 10, rate: float = 0.1, **kw):
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    return OneVsRest(classifier=GBTClassifier(maxDepth=max_depth, maxIter=rounds, stepSize=rate, seed=42), **kw)


def svc(c: float = 1.0, **kw):
    from pyspark.ml.classification import LinearSVC, OneVsRest

    return OneVsRest(classifier=LinearSVC(maxIter=50), **kw)  # ``fit`` sets the penalty from c and the rows


#: Estimator factories by name; add one to plug in a model.
MODELS: dict[str, Callable] = {"LogisticRegression": logistic, "RandomForest": forest, "XGBoost": boosting, "CatBoost": boosting, "SVC": svc}


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def fit(df: DataFrame, name: str, features: list[str], label: str, strategy: str = "none", key: str = "id", **params):
    """A fitted model; ``strategy`` is none, class_weight or smote. Weights go to models that take them."""
    if strategy == "smote":
        df = smote(df, key, label, features)
    rows = assembled(df.withColumn("label", F.col(label).cast("double")), features)
    model = MODELS[name](labelCol="label", featuresCol="features", **params)
    inner = model.getClassifier() if model.hasParam("classifier") else model
    if inner.hasParam("regParam"):
        # C weighs the sum of the losses, regParam the penalty against their mean.
        inner.setRegParam(1.0 / (params.get("c", 1.0) * max(rows.count(), 1)))
    if strategy == "class_weight" and model.hasParam("weightCol"):
        rows = rows.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)  # one row a class
        model = model.setWeightCol("weight")
    return model.fit(rows)


def predict(model, df: DataFrame, features: list[str], key: str = "id") -> DataFrame:
    return model.transform(assembled(df, features)).select(key, F.col("prediction").cast("int").alias("prediction"))


def cross_validate(df: DataFrame, name: str, features: list[str], label: str, grid: dict[str, list], strategies: tuple[str, ...] = ("none",), k: int = 5, key: str = "id") -> DataFrame:
    """The runs table: (model, strategy, params, mean_f1, std_f1) over folds; scaling and resampling are fitted inside a fold."""
    spark, parts = df.sparkSession, folds(df, key, label, k).cache()
    runs = []
    for strategy, values in itertools.product(strategies, itertools.product(*grid.values())):
        params, f1 = dict(zip(grid, values, strict=True)), []
        for i in range(k):
            train, held = parts.where(F.col("fold") != i), parts.where(F.col("fold") == i)
            z = scaler(train, features)
            model = fit(scaled(train, z), name, features, label, strategy, key, **params)
            scored = held.select(key, F.col(label).alias("y_true")).join(predict(model, scaled(held, z), features, key).withColumnRenamed("prediction", "y_pred"), key)
            f1.append(summary(report(scored)).head().macro_f1)
        runs.append((name, strategy, str(params), float(np.mean(f1)), float(np.std(f1))))
    parts.unpersist()
    return spark.createDataFrame(runs, "model string, strategy string, params string, mean_f1 double, std_f1 double")


def best_run(runs: DataFrame, model: str | None = None) -> DataFrame:
    rows = runs.where(F.col("model") == model) if model else runs
    return rows.orderBy(F.desc("mean_f1"), "model", "strategy", "params").limit(1)


# Scores ----------------------------------------------------------------------------------------------


def confusion(scored: DataFrame) -> DataFrame:
    """(y_true, y_pred, n, share): share is of the true class."""
    counts = scored.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y_true")))


def confusion_matrix(scored: DataFrame, classes: list[int]) -> DataFrame:
    """One row a true class, one column a predicted one."""
    rows = confusion(scored).groupBy("y_true").pivot("y_pred", classes).agg(F.sum("n"))
    return rows.fillna(0)


def report(scored: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of every class that is true or predicted somewhere."""
    c = confusion(scored)
    side = lambda col, name: c.groupBy(F.col(col).alias("label")).agg(F.sum("n").alias(name))
    hits = c.where("y_true = y_pred").select(F.col("y_true").alias("label"), F.col("n").alias("tp"))
    rows = side("y_true", "support").join(side("y_pred", "predicted"), "label", "full").join(hits, "label", "left").fillna(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select("label", share("tp", "predicted").alias("precision"), share("tp", "support").alias("recall"), (2 * F.col("tp") / (F.col("support") + F.col("predicted"))).alias("f1"), "support", "tp")


def summary(rep: DataFrame) -> DataFrame:
    """(macro_f1, weighted_f1, accuracy) from a report."""
    n = F.sum("support")
    return rep.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), (F.sum("tp") / n).alias("accuracy"))


def join_predictions(test: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Predictions beside the test rows, by id (rows without one keep a null)."""
    return test.join(predictions, key, "left")
