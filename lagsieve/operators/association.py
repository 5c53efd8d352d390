"""Association measures, as foils to certified value, and the summaries of evidence. Spectra and cross-correlations are kernels over whole channels; all else is Catalyst, but for the p-values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import kernels as K
from .probe import is_finite
from .series import Shared, series

NAN = float("nan")


def largest_correlation(x: np.ndarray, y: np.ndarray, most: int) -> float:
    """The largest absolute correlation over lags -most..most, by whole-series means and norms; NaN if either hardly varies."""
    x, y = x - x.mean(), y - y.mean()
    scale = float(np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))
    if scale <= K.EPS:
        return NAN
    n, most = len(x), min(most, len(x) - 1)
    return max(abs(float(x[max(k, 0) : n + min(k, 0)] @ y[max(-k, 0) : n - max(k, 0)])) for k in range(-most, most + 1)) / scale


def xcorr_absmax(panel: DataFrame, most: int = 24) -> DataFrame:
    """(a, b, xcorr) of each ordered pair: largest_correlation. An unordered pair is one task, and both directions have its value."""
    shared = Shared(panel)
    ids = panel.select("ch").distinct()
    pairs = ids.select(F.col("ch").alias("a")).join(ids.select(F.col("ch").alias("b")), F.col("a") < F.col("b"))
    tasks = shared.join(shared.join(pairs, "a", "za"), "b", "zb")
    n = max(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), panel.sparkSession.sparkContext.defaultParallelism)
    get = shared.getter()

    def run(batches):
        for batch in batches:
            out = [(t.a, t.b, largest_correlation(get(t, "a", "za"), get(t, "b", "zb"), most)) for t in batch.itertuples(index=False)]
            yield pd.DataFrame([x for a, b, r in out for x in ((a, b, r), (b, a, r))], columns=["a", "b", "xcorr"])

    found = tasks.repartition(n, "a", "b").mapInPandas(run, "a int, b int, xcorr double")
    return found.withColumn("xcorr", F.coalesce("xcorr", F.lit(NAN)))  # pandas hands NaN over as null


def power_spectrum(panel: DataFrame, n: int) -> DataFrame:
    """(ch, k, amplitude) of each channel's discrete Fourier transform over t in [0, n), bins 0..n/2."""

    def run(batches):
        for batch in batches:
            for ch, z in zip(batch["ch"], batch["z"]):
                yield pd.DataFrame({"ch": int(ch), "k": np.arange(n // 2 + 1), "amplitude": np.abs(np.fft.rfft(np.asarray(z, float)[:n], n))})

    return series(panel).mapInPandas(run, "ch int, k int, amplitude double")


def circular_autocorrelation(panel: DataFrame, n: int, most: int) -> DataFrame:
    """(ch, lag, r) with rows wrapped round."""
    w = W.partitionBy("ch")
    rows = panel.select("ch", "t", (F.col("z") - F.avg("z").over(w)).alias("x"))
    a = rows.select("ch", "x", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag"), "t").select("ch", "x", "lag", ((F.col("t") + F.col("lag")) % n).alias("t"))
    b = rows.select("ch", "t", F.col("x").alias("y"))
    s = a.join(b, ["ch", "t"]).groupBy("ch", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"), F.sum(F.col("x") * F.col("x")).alias("v"))
    return s.select("ch", "lag", (F.col("s") / F.col("v")).alias("r"))


def coherence(panel: DataFrame, n: int) -> DataFrame:
    """(a, b, mean, peak) of Welch coherence for each unordered pair: Hann segments, half overlapping, without their means."""
    size = min(256, max(32, n // 4))
    step = size - size // 2
    count = (n - size) // step + 1
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)

    def run(batches):
        for batch in batches:
            for ch, z in zip(batch["ch"], batch["z"]):
                parts = np.stack([np.asarray(z, float)[i * step : i * step + size] for i in range(count)])
                f = np.fft.rfft((parts - parts.mean(1, keepdims=True)) * hann)
                where = np.indices(f.shape)
                yield pd.DataFrame({"ch": int(ch), "seg": where[0].ravel(), "k": where[1].ravel(), "re": f.real.ravel(), "im": f.imag.ravel()})

    s = series(panel).mapInPandas(run, "ch int, seg int, k int, re double, im double")
    a, b = s.select(F.col("ch").alias("a"), "seg", "k", F.col("re").alias("ra"), F.col("im").alias("ia")), s.select(F.col("ch").alias("b"), "seg", "k", F.col("re").alias("rb"), F.col("im").alias("ib"))
    both = a.join(b, ["seg", "k"]).where("a < b")
    p = both.groupBy("a", "b", "k").agg(
        F.avg(F.col("ra") * F.col("rb") + F.col("ia") * F.col("ib")).alias("re"), F.avg(F.col("ra") * F.col("ib") - F.col("ia") * F.col("rb")).alias("im"),
        F.avg(F.col("ra") * F.col("ra") + F.col("ia") * F.col("ia")).alias("pa"), F.avg(F.col("rb") * F.col("rb") + F.col("ib") * F.col("ib")).alias("pb"),
    )
    power = F.col("pa") * F.col("pb")
    c = p.where(power > 1e-20).select("a", "b", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / power).alias("c"))
    return c.groupBy("a", "b").agg(F.avg("c").alias("coherence_mean"), F.max("c").alias("coherence_peak"))


def average_rank(value: str, keys: tuple[str, ...] = ()):
    """Rank with ties sharing their mean; windows by the keys."""
    w = W.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2


def spearman(rows: DataFrame, x: str, y: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, n, rho) over the rows where both values are finite; fewer than three give NaN."""
    good = rows.where(is_finite(F.col(x)) & is_finite(F.col(y)))
    r = good.select(*keys, average_rank(x, keys).alias("rx"), average_rank(y, keys).alias("ry"))
    s = r.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("rx", "ry").alias("c"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"))
    scale = F.sqrt(F.col("vx") * F.col("vy"))
    return s.select(*keys, "n", F.when((F.col("n") < 3) | (scale == 0), F.lit(NAN)).otherwise(F.col("c") / F.when(scale == 0, 1.0).otherwise(scale)).alias("rho"))


def spearman_pairs(panel: DataFrame) -> DataFrame:
    """(a, b, rho) of every unordered pair of channels over t."""
    ranks = panel.select("ch", "t", average_rank("z", ("ch",)).alias("r"))
    a, b = ranks.select(F.col("ch").alias("a"), "t", F.col("r").alias("ra")), ranks.select(F.col("ch").alias("b"), "t", F.col("r").alias("rb"))
    return a.join(b, "t").where("a < b").groupBy("a", "b").agg(F.corr("ra", "rb").alias("rho"))


def ks_uniform(rows: DataFrame, keys: tuple[str, ...], p: str = "p_value") -> DataFrame:
    """(keys, n, ks, fpr05, mean_p, median_p): distance of p-values from U(0, 1), and the share at most 0.05."""
    good = rows.where(is_finite(F.col(p)))
    w = W.partitionBy(*keys)
    r = good.select(*keys, F.col(p).alias("p"), F.row_number().over(w.orderBy(p)).alias("i"), F.count("*").over(w).alias("n"))
    gap = F.greatest(F.col("i") / F.col("n") - F.col("p"), F.col("p") - (F.col("i") - 1) / F.col("n"))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.max(gap).alias("ks"), F.avg((F.col("p") <= 0.05).cast("double")).alias("fpr05"), F.avg("p").alias("mean_p"), F.median("p").alias("median_p"))


def ecdf(rows: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, x, y): finite values in order with i / n, a row for each."""
    good = rows.where(is_finite(F.col(value)))
    w = W.partitionBy(*keys)
    return good.select(*keys, F.col(value).alias("x"), (F.row_number().over(w.orderBy(value)) / F.count("*").over(w)).alias("y"))


def by_label(edges: DataFrame, order: list[str]) -> DataFrame:
    """(place, edge_type, n, mean_delta, mean_gain, median_p, admitted_rate) for the labels in a fixed order; a missing one has NaN."""
    spark = edges.sparkSession
    labels = spark.createDataFrame(list(enumerate(order)), "place int, edge_type string")
    admitted = (F.coalesce("certified_candidate", F.lit(False)) & is_finite(F.col("p_value")) & (F.col("p_value") <= 0.10)).cast("double")
    s = edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.avg("delta_true").alias("mean_delta"), F.avg("aligned_gain").alias("mean_gain"), F.median("p_value").alias("median_p"), F.avg(admitted).alias("admitted_rate"))
    out = F.broadcast(labels).join(s, "edge_type", "left")
    return out.select("place", "edge_type", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(NAN)).alias(c) for c in ("mean_delta", "mean_gain", "median_p", "admitted_rate")])


def top_rejected(edges: DataFrame, k: int = 3) -> DataFrame:
    """The k rejected edges of highest coherence peak: association without value."""
    return edges.where(~F.coalesce("certified_candidate", F.lit(False))).orderBy(F.col("coherence_peak").desc(), "target", "source").limit(k).select("target", "source", "coherence_peak", "aligned_gain", "p_value")


def asymmetry(edges: DataFrame, k: int = 3) -> DataFrame:
    """The k pairs whose directions differ most in gain: (i, j, diff, gain_ij, gain_ji)."""
    e = edges.select("target", "source", "aligned_gain")
    f = e.select(F.col("target").alias("t2"), F.col("source").alias("s2"), F.col("aligned_gain").alias("gain_ji"))
    both = e.join(f, (F.col("target") == F.col("s2")) & (F.col("source") == F.col("t2")) & (F.col("target") < F.col("source")))
    return both.select(F.col("target").alias("i"), F.col("source").alias("j"), F.abs(F.col("aligned_gain") - F.col("gain_ji")).alias("diff"), F.col("aligned_gain").alias("gain_ij"), "gain_ji").orderBy(F.col("diff").desc(), F.col("i").desc(), F.col("j").desc()).limit(k)


def evidence_matrix(edges: DataFrame, value: str) -> DataFrame:
    """target and columns s0 ... s(n - 1): each edge's value, NaN where there is none; n is one more than the largest channel."""
    n = (edges.agg(F.max(F.greatest("target", "source"))).first()[0] if edges.take(1) else -1) + 1
    grid = edges.sparkSession.range(n).select(F.col("id").cast("int").alias("target"))
    made = edges.withColumn("v_", F.col(value).cast("double")).groupBy("target").pivot("source", list(range(n))).agg(F.last("v_"))
    return grid.join(made, "target", "left").select("target", *[F.coalesce(F.col(f"`{j}`"), F.lit(NAN)).alias(f"s{j}") for j in range(n)])


def summary_row(summary: DataFrame, dataset: str, pred_len: int, tier: str):
    """The run's row of a summary table; a run that isn't there ends the program."""
    found = summary.where((F.col("dataset") == dataset) & (F.col("pred_len") == pred_len) & (F.col("tier") == tier)).limit(1).collect()
    if not found:
        raise SystemExit(f"no summary row for {dataset}, {pred_len}, {tier}")
    return found[0]


def short_lines(text, most: int = 3) -> list[str]:
    """The first entries of rejected_text or asymmetry_text with short names; no text gives none."""
    if not isinstance(text, str) or text in ("", "nan"):
        return []
    return [part.replace("coherence_peak=", "coh=").replace("aligned_gain=", "gain=") for part in text.split("; ")[:most]]


def summary_box(rejected, asymmetric) -> str:
    """Both texts under their headings, an entry a line."""
    parts = [("High association, no value:", rejected), ("Direction asymmetry:", asymmetric)]
    return "\n\n".join("\n".join([head, *(f"  - {line}" for line in short_lines(text))]) for head, text in parts)


def rejected_text(rows: list) -> str:
    """top_rejected as one line; formatted here, since Java's %g isn't C's."""
    return "; ".join(f"{r['target']}<-{r['source']}: coherence_peak={r['coherence_peak']:.3g}, aligned_gain={r['aligned_gain']:.3g}, p={r['p_value']:.3g}" for r in rows)


def asymmetry_text(rows: list) -> str:
    return "; ".join(f"{r['i']}<-{r['j']} vs {r['j']}<-{r['i']}: diff={r['diff']:.3g}, gains={r['gain_ij']:.3g}/{r['gain_ji']:.3g}" for r in rows)
