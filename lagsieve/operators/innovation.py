"""A channel's own-history base model, and what it leaves unexplained."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans import splits as S
from . import ridge
from .lagged import within
from .series import series


class OwnBase(Protocol):
    """What a base model must offer; any kernel with these can take the ridge's place."""

    alpha: float

    def fit(self, X: np.ndarray, y: np.ndarray) -> OwnBase: ...

    def predict(self, X: np.ndarray) -> np.ndarray: ...


class RidgeBase:
    """Ridge on the own history, alpha by GCV."""

    def __init__(self, alphas, rule: str = "gcv"):
        if rule != "gcv":
            raise ValueError("the own base chooses its alpha by gcv")
        self.alphas, self.path, self.alpha = K.alpha_grid(alphas), None, float("nan")

    def fit(self, X, y) -> RidgeBase:
        self.path = K.ridge_path(X, y, self.alphas)
        self.alpha = self.path.best_gcv()
        return self

    def predict(self, X) -> np.ndarray:
        if self.path is None:
            raise RuntimeError("predict before fit")
        return self.path.predict(X, self.alpha)


def innovation_of(z: np.ndarray, splits: S.Splits, lookback: int, horizon: int, base: OwnBase) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{split: (rows, y, prediction)}; the base is fitted on the fit rows alone."""
    rows = {name: K.rows_of(r.start, r.end, lookback, horizon) for name, r in splits.roles().items()}
    if any(u[-1] >= splits.test.start for u in rows.values()):
        raise ValueError("a row of the test window")
    X = {name: K.lagged(z, u, lookback, horizon) for name, u in rows.items()}
    base.fit(X["train_fit"], z[rows["train_fit"]])
    return {name: (u, z[u], base.predict(X[name])) for name, u in rows.items()}


def innovations(panel: DataFrame, splits: S.Splits, lookback: int, horizon: int, alphas) -> DataFrame:
    """(target, split, u, y, pred, resid, alpha_own) of every channel."""

    def run(batches):
        for batch in batches:
            for ch, z in zip(batch["ch"], batch["z"]):
                base = RidgeBase(alphas)
                for name, (u, y, pred) in innovation_of(np.asarray(z, float), splits, lookback, horizon, base).items():
                    yield pd.DataFrame({"target": int(ch), "split": name, "u": u, "y": y, "pred": pred, "resid": y - pred, "alpha_own": base.alpha})

    return series(panel).mapInPandas(run, "target int, split string, u long, y double, pred double, resid double, alpha_own double")


def innovations_p1(lags: DataFrame, splits: S.Splits, alphas) -> DataFrame:
    """The same for one lag, in closed form: (ch, split, u, y, pred, resid, alpha)."""
    fits = ridge.fitted_p1(lags, splits, alphas, rule="gcv")
    rows = within(lags, S.Range(splits.train_fit.start, splits.cert.end)).join(fits, "ch")
    pred = F.col("slope") * F.col("x") + F.col("intercept")
    return rows.select("ch", S.role(splits, F.col("u")).alias("split"), "u", "y", pred.alias("pred"), (F.col("y") - pred).alias("resid"), "alpha")


def described(innovation: DataFrame, key: str = "ch") -> DataFrame:
    return innovation.groupBy(key, "split").agg(F.count("*").alias("n"), F.avg("resid").alias("mean"), F.stddev_pop("resid").alias("std"))
