"""Screening: which sources explain what a target's own history leaves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import kernels as K
from ..plans import splits as S
from ..sources.sinks import file_system
from . import ridge
from .innovation import RidgeBase, innovation_of, innovations_p1
from .lagged import within
from .probe import NAN, pairs
from .series import Shared

TOP = 4
#: Channels a side of a block of pairs; blocks of targets and of sources that a task takes.
BLOCK, TARGETS, SOURCES = 256, 4, 64
SCORES = "target int, source int, s_screen double, alpha_screen double, n_train_fit int, n_val_alpha int, n_cert int"


def targets(panel: DataFrame, chosen: list[int] | None = None, most: int | None = None) -> DataFrame:
    """The channels to screen: a list, or the first `most`."""
    ids = panel.select("ch").distinct()
    if chosen is not None:
        if len(set(chosen)) != len(chosen):
            raise ValueError("a target is listed twice")
        known = {r["ch"] for r in ids.where(F.col("ch").isin(list(chosen))).collect()}  # at most the list
        if missing := sorted(set(chosen) - known):
            raise ValueError(f"no such channels: {missing}")
        return ids.where(F.col("ch").isin(list(chosen)))
    return ids if most is None else ids.where(F.col("ch") < most)


def ranked(scores: DataFrame, top: int = TOP) -> DataFrame:
    """With screen_rank (finite scores first, larger first, then by source) and passed_screen."""
    if top <= 0:
        raise ValueError("top must be positive")
    bad = F.isnan("s_screen") | F.col("s_screen").isNull()
    w = W.partitionBy("target").orderBy(bad, F.col("s_screen").desc(), "source")
    out = scores.withColumn("screen_rank", F.row_number().over(w))
    return out.withColumn("passed_screen", (F.col("screen_rank") <= top) & ~bad)


def scores(panel: DataFrame, splits: S.Splits, lookback: int, horizon: int, alphas, *, rule: str = "val_grid", chosen=None, most=None) -> DataFrame:
    """R2, against zero, of each target's residuals on each source's window (SCORES). The own base is fitted once for the pairs of a target that lie together."""
    shared = Shared(panel)
    ids = targets(panel, chosen, most).select(F.col("ch").alias("target"))
    tasks = pairs(panel).join(ids, "target", "left_semi")
    tasks = shared.join(shared.join(tasks, "target", "zt"), "source", "zs")
    get = shared.getter()
    spark = panel.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tasks = tasks.repartition(n, "target").sortWithinPartitions("target", "source")

    def run(batches):
        last, found = None, None
        for batch in batches:
            out = []
            for t in batch.itertuples(index=False):
                if t.target != last:
                    last, found = t.target, innovation_of(get(t, "target", "zt"), splits, lookback, horizon, RidgeBase(alphas))
                resid = {k: y - p for k, (_, y, p) in found.items()}
                x = {k: K.lagged(get(t, "source", "zs"), u, lookback, horizon) for k, (u, _, _) in found.items()}
                path = K.ridge_path(x["train_fit"], resid["train_fit"], alphas)
                alpha = K.choose_alpha(path, x["val_alpha"], resid["val_alpha"], rule)
                out.append((t.target, t.source, K.residual_r2(resid["cert"], path.predict(x["cert"], alpha)), alpha, *(len(r) for r in resid.values())))
            yield pd.DataFrame.from_records(out, columns=[c.split()[0] for c in SCORES.split(", ")])

    return tasks.mapInPandas(run, SCORES).withColumn("s_screen", F.coalesce("s_screen", F.lit(NAN)))  # pandas hands NaN over as null


def screen(panel: DataFrame, splits: S.Splits, lookback: int, horizon: int, alphas, *, top: int = TOP, rule: str = "val_grid", chosen=None, most=None) -> DataFrame:
    return ranked(scores(panel, splits, lookback, horizon, alphas, rule=rule, chosen=chosen, most=most), top).withColumn("alpha_rule", F.lit(rule))


def scores_p1(lags: DataFrame, splits: S.Splits, alphas) -> DataFrame:
    """(target, source, alpha_screen, s_screen) with one lag, in closed form."""
    resid = innovations_p1(lags, splits, alphas).select(F.col("ch").alias("target"), "u", F.col("resid").alias("y"))
    rows = resid.join(lags.select(F.col("ch").alias("source"), "u", "x"), "u").where("target <> source")
    keys = ("target", "source")
    fits = ridge.fitted_p1(rows, splits, alphas, keys)
    cert = within(rows, splits.cert).join(fits, list(keys))
    e = F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")
    s = cert.groupBy(*keys).agg(F.max("alpha").alias("alpha_screen"), F.sum(e * e).alias("sse"), F.sum(F.col("y") * F.col("y")).alias("sst"))
    return s.select(*keys, "alpha_screen", F.when(F.col("sst") <= 1e-12, F.lit(NAN)).otherwise(1 - F.col("sse") / F.when(F.col("sst") <= 1e-12, 1.0).otherwise(F.col("sst"))).alias("s_screen"))


def wide_p1(sums: DataFrame, splits: S.Splits, alphas, folder: str, *, top: int = TOP) -> DataFrame:
    """(target, source, s_screen): scores_p1 of a wide panel, for the `top` best sources of each target in each run of SOURCES blocks.

    sums holds the panel's values (ch, t, v), zeros left out; a channel without any has one row with neither t nor v. Every pair is scored, by
    matrix products over blocks of targets and sources. A block's residuals and lags are a file in `folder`, written once and read by the tasks
    that need it, so nothing is shuffled a pair of blocks but the best scores. Scores that are equal in 12 digits are equal, and go by source.
    """
    roles = splits.roles()
    until, first, end = splits.pre_test.end, max(roles["train_fit"].start, 1), roles["cert"].end
    u = np.arange(first, end)
    rows = {name: (u >= r.start) & (u < r.end) for name, r in roles.items()}
    fit_end = splits.train_fit.start, splits.train_fit.end

    def stored(table: pa.Table) -> pa.Table:
        context = TaskContext.get()
        block = int(table.column("block")[0].as_py())
        path = f"{folder}/{block}-{context.taskAttemptId()}.arrow"
        ch, v = dense(table, until)
        z = scaled(v, *fit_end)
        y, x = z[:, first:end], z[:, first - 1 : end - 1]
        system, name = file_system(path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        kind = pa.binary(8 * len(u))
        held = pa.record_batch({"ch": pa.array(ch, pa.int32()), "y": packed(own_residuals(y, x, rows["train_fit"], alphas), kind), "x": packed(x, kind)})
        with system.open_output_stream(name, compression=None) as out, pa.ipc.new_file(out, held.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as file:
            file.write_batch(held)
        return pa.table({"block": pa.array([block], pa.int32()), "path": [path]})

    spark = sums.sparkSession
    blocks = sums.select(F.expr(f"CAST(ch DIV {BLOCK} AS INT)").alias("block"), F.col("ch").cast("int").alias("ch"), F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"))
    paths = [r["path"] for r in sorted(blocks.groupBy("block").applyInArrow(stored, "block int, path string").collect())]  # one row a block of channels
    runs = -(-len(paths) // SOURCES)
    n = -(-len(paths) // TARGETS) * runs

    def loaded(path: str, column: str) -> tuple[np.ndarray, np.ndarray]:
        system, name = file_system(path)
        with system.open_input_file(name) as f:
            table = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=[0, 1 if column == "y" else 2])).read_all().combine_chunks()
        data = table.column(column).chunk(0)
        return table.column("ch").to_numpy(), np.frombuffer(data.buffers()[1], np.float64).reshape(len(data), -1)

    def run(batches):
        for batch in batches:
            for task in batch.column(0).to_pylist():
                a, b = task // runs * TARGETS, task % runs * SOURCES
                own = [(ch, Part(v, rows), Best(ch, top)) for ch, v in (loaded(p, "y") for p in paths[a : a + TARGETS])]
                for path in paths[b : b + SOURCES]:
                    source, v = loaded(path, "x")
                    x = Part(v, rows)
                    for target, y, best in own:
                        score = np.round(best_p1(y, x, alphas), 12)
                        score[target[:, None] == source[None, :]] = NAN
                        best.add(source, score)
                for _, _, best in own:
                    yield best.rows()

    tasks = spark.range(0, n, 1, max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, n // 16))))
    return tasks.mapInArrow(run, "target int, source int, s_screen double")


def dense(table: pa.Table, until: int) -> tuple[np.ndarray, np.ndarray]:
    """(channels in order, their values over [0, until)) of rows (ch, t, v); what is not there is 0."""
    ch, which = np.unique(table.column("ch").to_numpy(), return_inverse=True)
    t, v = (table.column(c).to_numpy() for c in ("t", "v"))
    good = ~np.isnan(t.astype(float)) & (t < until) & np.array(table.column("v").is_valid())
    out = np.zeros((len(ch), until))
    out[which[good], t[good].astype(np.int64)] = v[good]
    return ch, out


def scaled(v: np.ndarray, start: int, end: int) -> np.ndarray:
    """operators.scale of rows of values; a constant row's deviation is 0 exactly."""
    base = v[:, start : start + 1]
    mean = base + (v[:, start:end] - base).mean(axis=1, keepdims=True)
    sd = np.sqrt(((v[:, start:end] - mean) ** 2).mean(axis=1, keepdims=True))
    return (v - mean) / np.where(sd == 0, 1.0, sd)


def own_residuals(y: np.ndarray, x: np.ndarray, fit: np.ndarray, alphas) -> np.ndarray:
    """innovations_p1 of each row: what ridge on its own lag leaves, the first alpha of least GCV."""
    a, b, n = y[:, fit], x[:, fit], int(fit.sum())
    my, mx = a.mean(axis=1), b.mean(axis=1)
    a, b = a - my[:, None], b - mx[:, None]
    vy, vx, cxy = (a * a).mean(axis=1), (b * b).mean(axis=1), (a * b).mean(axis=1)
    least, chosen = np.full(len(y), np.inf), np.zeros(len(y))
    for alpha in alphas:
        slope = n * cxy / (n * vx + alpha)
        room = 1 - n * vx / (n * vx + alpha) / n
        gcv = (vy - 2 * slope * cxy + slope * slope * vx) / (room * room)
        better = gcv < least
        least, chosen = np.where(better, gcv, least), np.where(better, slope, chosen)
    return y - chosen[:, None] * x - (my - chosen * mx)[:, None]


def packed(v: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of doubles as one binary value each."""
    return pa.Array.from_buffers(kind, len(v), [None, pa.py_buffer(np.ascontiguousarray(v))])


class Part:
    """Rows of a block about their fit means (so that an intercept is nothing), split by role, with their sums of squares; sst is that of the cert columns as they are."""

    def __init__(self, v: np.ndarray, rows: dict[str, np.ndarray]):
        self.sst = (v[:, rows["cert"]] ** 2).sum(axis=1)
        v = v - v[:, rows["train_fit"]].mean(axis=1, keepdims=True)
        self.fit, self.val, self.cert = (np.ascontiguousarray(v[:, rows[k]]) for k in ("train_fit", "val_alpha", "cert"))
        self.fit2, self.val2, self.cert2 = ((p * p).sum(axis=1) for p in (self.fit, self.val, self.cert))


class Best:
    """The best sources of each target of a block so far: larger scores first, then smaller sources, which must come in order. NaN passes no screen."""

    def __init__(self, target: np.ndarray, top: int):
        self.target, self.top = target, top
        self.score, self.source = np.full((len(target), top), -np.inf), np.full((len(target), top), -1)

    def add(self, source: np.ndarray, score: np.ndarray) -> None:
        with np.errstate(invalid="ignore"):
            at = np.flatnonzero((score > self.score[:, -1:]).any(axis=1))
        if not len(at):
            return
        both = np.concatenate([self.score[at], np.where(np.isnan(score[at]), -np.inf, score[at])], axis=1)
        names = np.concatenate([self.source[at], np.broadcast_to(source, (len(at), len(source)))], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, : self.top]
        self.score[at], self.source[at] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)

    def rows(self) -> pa.RecordBatch:
        good = np.isfinite(self.score)
        return pa.record_batch({"target": pa.array(np.repeat(self.target, self.top)[good.ravel()], pa.int32()), "source": pa.array(self.source[good], pa.int32()), "s_screen": pa.array(self.score[good])})


def best_p1(y: Part, x: Part, alphas) -> np.ndarray:
    """R2, against zero, of each row of y on each row of x over the cert columns: ridge on the fit columns, the first alpha of least error on the alpha columns."""
    sxy, val, cert = y.fit @ x.fit.T, y.val @ x.val.T, y.cert @ x.cert.T
    least, chosen = np.full(sxy.shape, np.inf), np.zeros(sxy.shape)
    for alpha in alphas:
        slope = sxy / (x.fit2 + alpha)
        error = y.val2[:, None] - 2 * slope * val + slope * slope * x.val2
        better = error < least
        np.copyto(least, error, where=better)
        np.copyto(chosen, slope, where=better)
    safe = np.where(y.sst <= ridge.TINY, 1.0, y.sst)[:, None]
    error = y.cert2[:, None] - 2 * chosen * cert + chosen * chosen * x.cert2
    return np.where(y.sst[:, None] <= ridge.TINY, NAN, 1 - error / safe)
