"""Splits, linear models from one aggregate, validation, resampling, rules of trees, self-training."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import positions


SLICES = 3  # hex digits of a hash by which a class is ranked in parts: 4,096


def ranked(rows: DataFrame, id_column: str, by: list[str], seed: int = 0, ties: str | None = None) -> DataFrame:
    """Adds ``nth`` and ``of``: the row's seeded place within its class and the size of the class; rows of equal hash by ``ties``, else by the id.

    A class is ranked in slices of the hash, each after the rows of those before
    it: classes may be few, and no task takes a whole one. Only the counts of the
    slices, 4,096 of a class, meet in one.
    """
    from .mining import tasks

    parts = tasks(rows)
    hashed = F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f"/{seed}")))
    place = [F.struct(*by).alias("_class"), F.coalesce(F.substring(hashed, 1, SLICES), F.lit("")).alias("_slice")]  # a struct of nulls equals another
    counts = rows.select(*place).groupBy("_class", "_slice").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_class")
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("_class", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("of"))
    inside = Window.partitionBy("_class", "_slice").orderBy("_hash", ties or id_column)
    placed = rows.select("*", F.unhex(hashed).alias("_hash"), *place).repartition(parts, "_class", "_slice").withColumn("_at", F.row_number().over(inside))
    joined = placed.join(sums.repartition(parts, "_class", "_slice"), ["_class", "_slice"])
    return joined.withColumn("nth", F.col("_before") + F.col("_at")).select(*rows.columns, "nth", "of")


def stratified_split(rows: DataFrame, id_column: str, by: list[str], share: float = 0.8, seed: int = 0) -> DataFrame:
    """Adds ``train``: whether the row is in the seeded share of its class."""
    return ranked(rows, id_column, by, seed).withColumn("train", F.col("nth") <= F.floor(F.col("of") * share)).drop("nth", "of")


def random_split(rows: DataFrame, id_column: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    """Adds ``train`` by the first 32 bits of a seeded hash of the id; no shuffle, reruns agree."""
    u = F.conv(F.substring(F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f"/{seed}"))), 1, 8), 16, 10).cast("long")
    return rows.withColumn("train", u < int(share * 2**32))


def folds(rows: DataFrame, id_column: str, by: list[str], k: int, seed: int = 0) -> DataFrame:
    """Adds ``fold`` 0 .. k - 1, of equal shares of every class."""
    return ranked(rows, id_column, by, seed).withColumn("fold", (F.col("nth") - 1) % k).drop("nth", "of")


def undersampled(rows: DataFrame, id_column: str, label: str, seed: int = 0) -> DataFrame:
    """As many rows of every class as the smallest has, by seeded hash."""
    least = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))  # one row
    return ranked(rows, id_column, [label], seed).crossJoin(F.broadcast(least)).where("nth <= least").drop("nth", "of", "least")


def prior_corrected(p: Column, share_in_sample: float, share: float) -> Column:
    """Probability after a change of the class's share (undersampling) is undone."""
    up, down = p * share / share_in_sample, (1 - p) * (1 - share) / (1 - share_in_sample)
    return up / (up + down)


class Moments:
    """Sums of products of features and label; models of any subset and penalty come from them without another pass."""

    def __init__(self, z: np.ndarray, features: list[str]):
        self.z, self.features = z, features

    @classmethod
    def of(cls, rows: DataFrame, features: list[str], label: str, by: str | None = None) -> dict:
        """Moments by value of ``by`` (a fold: few values), or under None. One aggregate; (features + 2)**2 numbers a value."""
        columns = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(label).cast("double")]
        n = len(columns)
        sums = [F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]
        found = (rows.groupBy(by) if by else rows.groupBy()).agg(*sums).collect()
        out = {}
        for r in found:
            z = np.zeros((n, n))
            for i in range(n):
                for j in range(i, n):
                    z[i, j] = z[j, i] = r[f"s{i}_{j}"] or 0.0
            out[r[by] if by else None] = cls(z, features)
        return out

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.z + other.z, self.features)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.z - other.z, self.features)

    def _scaled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
        """Correlation-like matrix of standardised features, vector with the label, means, label mean, deviations."""
        n, mean = self.z[0, 0], self.z[0, 1:] / self.z[0, 0]
        cov = self.z[1:, 1:] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 1e-300))
        return cov[:-1, :-1] / np.outer(sd, sd), cov[:-1, -1] / sd, mean[:-1], mean[-1], sd

    def ridge(self, penalty: float = 0.0) -> np.ndarray:
        """Intercept and coefficients; the penalty is on standardised features, a row of data counting 1 / n."""
        a, b, mean, label, sd = self._scaled()
        beta = np.linalg.lstsq(a + penalty * np.eye(len(a)), b, rcond=None)[0] / sd
        return np.concatenate([[label - mean @ beta], beta])

    def lasso(self, penalty: float, rounds: int = 10_000) -> np.ndarray:
        """Intercept and coefficients by coordinate descent on the moments."""
        a, b, mean, label, sd = self._scaled()
        beta = np.zeros(len(b))
        for _ in range(rounds):
            before = beta.copy()
            for j in range(len(b)):
                r = b[j] - a[j] @ beta + a[j, j] * beta[j]
                beta[j] = np.sign(r) * max(abs(r) - penalty, 0.0) / a[j, j]
            if np.abs(beta - before).max() < 1e-12:
                break
        beta = beta / sd
        return np.concatenate([[label - mean @ beta], beta])

    def principal(self, components: int) -> np.ndarray:
        """Intercept and coefficients of the regression on the first principal components."""
        a, b, mean, label, sd = self._scaled()
        values, vectors = np.linalg.eigh(a)
        v = vectors[:, ::-1][:, :components]
        beta = v @ ((v.T @ b) / values[::-1][:components]) / sd
        return np.concatenate([[label - mean @ beta], beta])

    def squared_error(self, model: np.ndarray) -> float:
        """Sum of squared residuals of a model on the rows of these moments."""
        w = np.concatenate([model, [-1.0]])
        return float(max(w @ self.z @ w, 0.0))

    def t_values(self) -> np.ndarray:
        """t of intercept and coefficients of the unpenalised model."""
        n, p = self.z[0, 0], len(self.z) - 1
        model = self.ridge()
        inverse = np.linalg.inv(self.z[:-1, :-1])
        return model / np.sqrt(np.diag(inverse) * self.squared_error(model) / (n - p))

    def p_values(self) -> np.ndarray:
        """Two-sided p by the normal distribution, which t approaches for many rows."""
        from math import erfc, sqrt

        return np.array([erfc(abs(t) / sqrt(2)) for t in self.t_values()])


def polynomial(rows: DataFrame, feature: str, degree: int) -> tuple[DataFrame, list[str]]:
    """Powers of a feature as columns."""
    names = [f"{feature}_{i}" for i in range(1, degree + 1)]
    return rows.withColumns({n: F.pow(F.col(feature).cast("double"), F.lit(i + 1)) for i, n in enumerate(names)}), names


def grid_search(rows: DataFrame, features: list[str], label: str, fold: str, penalties: list[float]) -> list[tuple[float, float]]:
    """(penalty, root mean squared error over all folds), best first: every fold is left out by subtraction, so the rows are read once."""
    by_fold = Moments.of(rows, features, label, fold)
    total = None
    for m in by_fold.values():
        total = m if total is None else total + m
    errors = []
    for penalty in penalties:
        wrong = sum(m.squared_error((total - m).ridge(penalty)) for m in by_fold.values())
        errors.append((penalty, (wrong / total.z[0, 0]) ** 0.5))
    return sorted(errors, key=lambda x: (x[1], x[0]))


def selected(moments: Moments, most: float = 0.05) -> list[str]:
    """Features whose coefficient has p <= most, by absolute t."""
    t, p = moments.t_values()[1:], moments.p_values()[1:]
    order = np.argsort(-np.abs(t), kind="stable")
    return [moments.features[i] for i in order if p[i] <= most]


def predict(rows: DataFrame, features: list[str], model: np.ndarray, floor: float | None = None) -> DataFrame:
    """Adds ``prediction`` of a linear model as one column expression."""
    value = F.lit(float(model[0]))
    for f, w in zip(features, model[1:], strict=True):
        value = value + F.col(f).cast("double") * F.lit(float(w))
    return rows.withColumn("prediction", value if floor is None else F.greatest(value, F.lit(float(floor))))


def smote(minority: DataFrame, neighbours: DataFrame, id_column: str, vector: str, seed: int = 0) -> DataFrame:
    """Synthetic rows between a minority row and its neighbours (id, other): (id, other, vector)."""
    u = F.conv(F.substring(F.md5(F.concat_ws("/", "id", "other", F.lit(seed))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    a = minority.select(F.col(id_column).alias("id"), F.col(vector).alias("a"))
    b = minority.select(F.col(id_column).alias("other"), F.col(vector).alias("b"))
    return neighbours.join(a, "id").join(b, "other").withColumn("u", u).select("id", "other", F.zip_with("a", "b", lambda x, y: x + F.col("u") * (y - x)).alias(vector))


def tree_rules(model, names: list[str]) -> str:
    """Nested if/else text of a fitted tree of pyspark.ml."""
    out = []
    for line in model.toDebugString.splitlines()[1:]:
        depth = (len(line) - len(line.lstrip())) // 1
        text = re.sub(r"feature (\d+)", lambda m: names[int(m[1])], line.strip())
        text = re.sub(r"^If \((.*)\)$", r"if \1:", text)
        text = re.sub(r"^Else \(.*\)$", "else:", text)
        out.append(" " * depth + re.sub(r"^Predict: ", "return ", text))
    return "\n".join(out)


def self_training(rows: DataFrame, fit, steps: int, keep, most: int, seed_label: str = "label") -> DataFrame:
    """Rows (id, features, label or null), where ``most`` rows a step of those without a label get the model's, the surest first.

    ``fit(labelled)`` gives a function of rows that adds ``prediction`` and
    ``margin``; ``keep`` writes or checkpoints a frame, so that the plan of a
    step doesn't hold those before.
    """
    now = rows
    for _ in range(steps):
        left = now.where(F.col(seed_label).isNull())
        if left.isEmpty():
            break
        judged = fit(now.where(F.col(seed_label).isNotNull()))(left)
        best = judged.orderBy(F.desc("margin"), "id").limit(most).select("id", F.col("prediction").alias("new"))
        now = keep(now.join(best, "id", "left").withColumn(seed_label, F.coalesce(seed_label, "new")).drop("new"))
    return now


def auc(rows: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """One row auc: the share of pairs of a positive (label 1) and a negative (label 0) row that the score orders, ties half; null without one of them.

    A row's rank is the mean place of the rows of its score; places come from
    ranges, so no task takes the whole table. Rows without a score or with
    another label take no part.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).select(F.col(score).alias("s"), F.col(label).alias("y"), F.col(key).alias("k"))
    each = positions(known, "s", "k", name="nth").groupBy("s").agg(F.avg("nth").alias("rank"), F.count_if(F.col("y") == 1).alias("p"), F.count("*").alias("n"))
    sums = each.agg(F.sum(F.col("rank") * F.col("p")).alias("ranks"), F.sum("p").cast("double").alias("p"), F.sum(F.col("n") - F.col("p")).cast("double").alias("q"))
    return sums.select(F.try_divide(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))
