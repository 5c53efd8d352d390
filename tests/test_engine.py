"""CSV sources, shared panels, recovery, calibration, and what a run prints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagsieve import config
from lagsieve import queries as core
from lagsieve.config import Dataset
from lagsieve.functions import generators as G
from lagsieve.functions import kernels as K
from lagsieve.operators import association as X
from lagsieve.operators import probe as P
from lagsieve.operators import screen as SC
from lagsieve.operators import series
from lagsieve.plans import pipelines as J
from lagsieve.sources import panel as sources

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_stops_before_the_limit(spark, tmp_path):
    rows = [f"2024-01-{1 + t // 4:02d},{t}.5,{-t}" for t in range(40)]
    rows[29] = "2024-01-08,not a number,x"
    path = tmp_path / "a.csv"
    path.write_text("\n".join(["date,a,b", *rows]) + "\n")
    info = Dataset("a", "a.csv", "ETT_hour", 2)
    panel = sources.csv_panel(spark, str(path), info, 10)
    assert "SinglePartition" not in plan(panel)
    # dates tie: the file's order counts
    assert sorted((r["t"], r["ch"], r["v"]) for r in panel.collect()) == sorted((t, c, v) for t in range(10) for c, v in ((0, t + 0.5), (1, float(-t))))
    assert sources.csv_panel(spark, str(path), info, 29).count() == 58
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sources.csv_panel(spark, str(path), info, 30).collect()


def test_csv_rows_keep_their_order_over_many_splits(spark, tmp_path):
    path = tmp_path / "long.csv"
    n = 30_000
    path.write_text("\n".join(["date,a", *(f"same day,{t}" for t in range(n))]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        panel = sources.csv_panel(spark, str(path), Dataset("a", "", "ETT_hour", 1), 20_000)
        got = panel.agg(F.count("*").alias("n"), F.count_if(F.col("t") == F.col("v")).alias("same"), F.max("t").alias("last")).first()
        assert panel.rdd.getNumPartitions() > 3 and tuple(got) == (20_000, 20_000, 19_999)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_events_outside_the_panel_are_an_error(spark, tmp_path):
    spark.sql("SELECT TIMESTAMP '2024-03-01 00:00:00' AS ts, 'a' AS event_type, 1L AS user_id, 2.0D AS value").write.parquet(str(tmp_path / "events.parquet"))
    with pytest.raises(Exception, match="outside the panel"):
        sources.events_hourly(spark, str(tmp_path)).collect()


def test_panels_sent_or_joined_give_the_same(spark, monkeypatch):
    panel = core.zpanel(spark, SF)
    run = lambda: (
        sorted(map(tuple, core.certified(spark, SF).select("target", "source", "delta_true", "p_value").collect())),
        sorted(map(tuple, J.screen_then_certify(panel, core.SPLITS, core.SMALL, top=2)["group"].select("target", "source", "delta_true", "p_value").collect())),
        sorted(map(tuple, SC.screen(panel, core.SPLITS, 6, 1, core.ALPHAS).select("target", "source", "s_screen").collect())),
        sorted(map(tuple, X.xcorr_absmax(panel).collect())),
    )
    sent = run()
    long = P.deltas(panel, P.pairs(panel), core.SPLITS, J.probe_of(core.SMALL, 5))
    assert not any(name in plan(long) for name in ("zt#", "zs#"))  # keys alone are shuffled
    monkeypatch.setattr(series, "SHARED_BYTES", 0)
    assert run() == sent


def test_parallelism_is_checked_and_used(spark):
    with pytest.raises(ValueError):
        P.Probe(1, 1, (1.0,), 5, parallelism=0)
    panel = core.zpanel(spark, SF)
    long = P.deltas(panel, P.pairs(panel), core.SPLITS, P.Probe(1, 1, (1.0,), 5, parallelism=3))
    assert long.rdd.getNumPartitions() <= 3


def test_recovery_run(spark):
    edges = J.recovery(spark).persist()
    assert {(r["target"], r["source"], r["edge_type"]) for r in edges.collect()} == set(G.RECOVERY_EDGES)
    rows = {r["edge_type"]: r for r in J.recovery_summary(edges).collect()}
    assert [rows[k]["n"] for k in J.RECOVERY_LABELS] == [4, 4, 4]
    assert rows["TRUE"]["mean_delta"] > rows["NULL"]["mean_delta"] and rows["TRUE"]["admitted_rate"] >= 0.75
    assert rows["DECOY"]["decoy_mean_delta"] == pytest.approx(rows["DECOY"]["mean_delta"]) and rows["DECOY"]["decoy_failed"] == (rows["DECOY"]["mean_delta"] > 0.01)
    # an edge by itself, with its own seed
    t, s, _ = G.RECOVERY_EDGES[5]
    one = J.certify_pair(spark, G.recovery(2026, 360), t, s, J.S.figure_splits(360), P.Probe(6, 1, (0.1, 1.0, 10.0, 100.0), 39, 2026 + 5 * J.RECOVERY_STEP)).first()
    same = edges.where(f"target = {t} AND source = {s}").first()
    assert one["p_value"] == same["p_value"] and one["aligned_gain"] == pytest.approx(same["aligned_gain"])
    edges.unpersist()


def test_null_pairs_are_calibrated(spark):
    rows = J.calibration(spark).withColumn("all", F.lit(1))
    s = X.ks_uniform(rows, ("all",)).first()
    assert s["n"] == 45 and 0.35 <= s["mean_p"] <= 0.65 and s["fpr05"] <= 0.12 and s["ks"] < 0.24  # 1.63 / sqrt(45): p = 0.01


def test_evidence_matrix_lookup_and_text(spark):
    edges = spark.createDataFrame([(0, 2, 0.5), (2, 0, -1.0)], "target int, source int, gain double")
    m = {r["target"]: [r[f"s{j}"] for j in range(3)] for r in X.evidence_matrix(edges, "gain").collect()}
    assert m[0][2] == 0.5 and m[2][0] == -1.0 and sum(np.isnan(v) for row in m.values() for v in row) == 7
    assert X.evidence_matrix(edges.limit(0), "gain").count() == 0
    summary = spark.createDataFrame([("ETTh1", 96, "formal", 3)], "dataset string, pred_len int, tier string, x int")
    assert X.summary_row(summary, "ETTh1", 96, "formal")["x"] == 3
    with pytest.raises(SystemExit):
        X.summary_row(summary, "ETTh1", 96, "smoke")
    text = "0<-1: coherence_peak=0.9, aligned_gain=-1, p=0.5; 1<-2: coherence_peak=0.8, aligned_gain=0, p=1; c; d"
    assert X.short_lines(text) == ["0<-1: coh=0.9, gain=-1, p=0.5", "1<-2: coh=0.8, gain=0, p=1", "c"] and X.short_lines(None) == X.short_lines("nan") == []
    assert X.summary_box(text, None).splitlines()[1] == "  - 0<-1: coh=0.9, gain=-1, p=0.5"


def test_report_and_config_paths(spark, tmp_path, capsys):
    J.run_reference(spark, config.load("smoke").with_(lookback=6, pred_len=1, B=5), output=str(tmp_path))
    lines = capsys.readouterr().out.splitlines()
    assert sum(x.startswith("target=") for x in lines) == 12 and "summary:" in lines
    assert config.load("lagsieve/configs/smoke.yaml") == config.load("smoke")


def test_one_alpha_is_a_path_of_one():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=40)
    assert np.allclose(K.ridge(x, y, 0.5).coef[0], K.ridge_path(x, y, (0.1, 0.5)).coef[1])
    z = np.arange(12.0)
    assert K.turned(z, 0, 2, 1).tolist() == [3, 4, 5, 6, 7, 8, 9, 10, 0, 1, 2, 11]
    assert X.largest_correlation(z, np.ones(12), 3) != X.largest_correlation(z, np.ones(12), 3)  # NaN
