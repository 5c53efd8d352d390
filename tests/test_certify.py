import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagsieve.config import Config
from lagsieve.functions import generators as G
from lagsieve.functions import kernels as K
from lagsieve.operators import admission as A
from lagsieve.operators import association as X
from lagsieve.operators import nulls as N
from lagsieve.operators import probe as P
from lagsieve.operators import screen as SC
from lagsieve.plans import pipelines as J
from lagsieve.plans import splits as S

NAN = float("nan")
SMALL = Config("", "made", 1, 6, 2026, "formal", (0.5, 0.25, 0.25), 3, (0.01, 0.1, 1.0, 10.0), "phase", 39)


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_step_up_goldens(spark):
    e = spark.createDataFrame([(0, 1, 0.01, True, 20), (0, 2, 0.02, False, 20), (0, 3, NAN, True, 20), (1, 0, 0.20, True, 20)], "target int, source int, p_value double, certified_candidate boolean, B int")
    out = rows(A.benjamini_hochberg(e), "target", "source")
    assert [out[k]["fdr_pass"] for k in ((0, 1), (0, 2), (0, 3), (1, 0))] == [True, False, False, False]
    assert all(r["fdr_underpowered"] for r in out.values())
    assert not any(r["fdr_underpowered"] for r in A.benjamini_hochberg(e.drop("B")).collect())
    none = A.benjamini_hochberg(e.withColumn("p_value", F.lit(None).cast("double")))
    assert none.where("fdr_pass").count() == 0
    with pytest.raises(ValueError):
        A.benjamini_hochberg(e, 0.0)
    with pytest.raises(ValueError, match="p_value"):
        A.benjamini_hochberg(e.drop("p_value"))


def test_step_up_equals_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(200) ** 3, 2)
    e = spark.createDataFrame([(int(i % 3), int(i), float(x), True) for i, x in enumerate(p)], "target int, source int, p_value double, certified_candidate boolean")
    out = rows(A.benjamini_hochberg(e, per=("target",)), "source")
    for t in range(3):
        mine = p[np.arange(200) % 3 == t]
        order = np.sort(mine)
        passing = order[order <= np.arange(1, len(order) + 1) / len(order) * 0.1]
        cutoff = passing[-1] if len(passing) else -1
        assert all(out[(i,)]["fdr_pass"] == (p[i] <= cutoff) for i in range(t, 200, 3))


def test_stability_and_admission_goldens(spark):
    e = spark.createDataFrame([(0, s, True, True) for s in (1, 2, 3)], "target int, source int, certified_candidate boolean, fdr_pass boolean")
    b = spark.createDataFrame([(0, 1, True, 0), (0, 2, True, 0), (0, 1, True, 1), (0, 3, True, 1), (0, 2, True, 2), (0, 2, True, 2), (0, 1, None, 2)], "target int, source int, certified_candidate boolean, block int")
    out = rows(A.admit(A.stability(e, b, 3, 2 / 3)), "source")
    assert [(round(out[(s,)]["stability_fraction"], 6), out[(s,)]["e_certified"]) for s in (1, 2, 3)] == [(0.666667, True), (0.666667, True), (0.333333, False)]
    assert A.stability(e, b, 0).where("stability_pass").count() == 0
    assert A.admit(e.withColumn("stability_pass", F.lit(False))).where("e_certified").count() == 0
    assert A.admit(e, stable=False).where("e_certified").count() == 3


def test_gates_fail_on_nan(spark):
    cases = [(1, 0.1, 0.1, 50, 1.0, 50.0, 1.0, 1.0), (2, NAN, 0.1, 50, 1.0, 50.0, 1.0, 1.0), (3, 0.1, NAN, 50, 1.0, 50.0, 1.0, 1.0), (4, 0.1, 0.1, 7, 1.0, 50.0, 1.0, 1.0), (5, 0.1, 0.1, 50, 0.0, 0.0, 1.0, 1.0), (6, 0.1, 0.1, 50, 1.0, 50.0, 0.0, 0.0), (7, -0.1, 0.1, 50, 1.0, 50.0, 1.0, 1.0)]
    df = spark.createDataFrame(cases, "edge int, delta_true double, aligned_gain double, n_cert int, var_y double, sst double, max_abs_x double, norm_x double")
    assert {r["edge"] for r in P.gates(df).where("certified_candidate").collect()} == {1}


def test_planted_edges(spark):
    assert J.planted_verdict(J.planted(spark)) == {"strong_recovered": True, "zero_rejected": True, "decoy_rejected": True}


def test_reference_run_and_its_invariance_to_partitions(spark):
    panel = G.panel(spark, G.planted()).where("ch <> 2")
    splits = S.planted_splits()[0]
    assert J.effective_B("formal", 7, 200) == 300 and J.effective_B("formal", 21, 200) == 1000 and J.effective_B("sanity", 21, 39) == 39
    probe = replace(J.probe_of(SMALL, 19), slice=5)
    blocks = S.cert_blocks(splits, 3)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        long = P.deltas(panel, P.pairs(panel), splits, probe, blocks)
        found.append(sorted(P.summarized(long, 19).select("target", "source", "block", "delta_true", "p_value", "aligned_gain").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 6 * 4


def test_blocks_equal_probes_of_their_own(spark):
    panel = G.panel(spark, G.planted())
    splits = S.planted_splits()[0]
    edges = spark.createDataFrame([(0, 1)], "target int, source int")
    probe = J.probe_of(SMALL, 9)
    blocks = S.cert_blocks(splits, 2)
    at_once = {r["block"]: r for r in P.summarized(P.deltas(panel, edges, splits, probe, blocks), 9).collect()}
    for i, b in enumerate(blocks):
        alone = P.certify(panel, edges, b, probe).first()
        assert all(alone[c] == at_once[i][c] for c in ("delta_true", "p_value", "n_cert", "alpha_joint", "certified_candidate"))


def test_unrelated_pairs_give_even_p_values():
    splits = S.Splits(S.Range(0, 250), S.Range(120, 180), S.Range(250, 260), S.Range(0, 250), S.Range(40, 120), S.Range(120, 180), S.Range(180, 250))
    probe = P.Probe(5, 1, (0.1, 1.0, 10.0, 100.0), 79)
    p = []
    for k in range(45):
        v = G.null_pair(1000 + k, 260)
        out = {r[4]: r[5] for r in P.run_task(0, 1, "pairwise", v[:, 0], v[:, 1], [], 0, 0, 79, splits, probe, [], {})}
        p.append((1 + sum(out[b] >= out[-1] for b in range(79))) / 80)
    p = np.array(p)
    assert K.ks_uniform(p)[1] > 0.01 and 0.35 <= p.mean() <= 0.65 and (p <= 0.05).mean() <= 0.12


def test_constant_target_is_undefined(spark):
    v = np.column_stack([np.ones(60), np.sin(np.arange(60.0))])
    splits = S.Splits(S.Range(0, 50), S.Range(25, 38), S.Range(50, 60), S.Range(0, 50), S.Range(5, 25), S.Range(25, 38), S.Range(38, 50))
    r = J.certify_pair(spark, v, 0, 1, splits, P.Probe(2, 1, (1.0,), 5)).first()
    assert r["delta_true"] is not None and math.isnan(r["delta_true"]) and math.isnan(r["p_value"]) and r["unstable_metric"] and not r["certified_candidate"]


def test_guards(spark):
    for bad in ({"B": 0}, {"null_method": "other"}):
        with pytest.raises(ValueError):
            P.Probe(**{"lookback": 2, "horizon": 1, "alphas": (1.0,), "B": 3} | bad)
    wide = spark.range(40).select(F.lit(0).alias("t"), F.col("id").cast("int").alias("ch"), F.lit(0.0).alias("z"))
    with pytest.raises(SystemExit):
        J.reference(wide, S.planted_splits()[0], SMALL)
    with pytest.raises(SystemExit):
        J.sanity(wide, S.planted_splits()[0], SMALL)


def test_screen_ranks_the_driver_first_and_certifies_groups(spark):
    panel = G.panel(spark, G.planted())
    splits = S.planted_splits()[0]
    out = J.screen_then_certify(panel, splits, SMALL, top=2, most_targets=1, B=9)
    screened = rows(out["screen"], "target", "source")
    assert screened[0, 1]["screen_rank"] == 1 and sum(r["passed_screen"] for r in screened.values()) == 2
    group = rows(out["group"], "target", "source")
    assert {r["group_id"] for r in group.values()} == {"target_0_top2"} and group[0, 1]["delta_true"] > 0.1
    curve = A.recall_curve(out["screen"], out["pairwise"].withColumn("e_certified", F.col("source") == 1), 3).orderBy("m").collect()
    assert [r["recall"] for r in curve] == [1.0, 1.0, 1.0] and [r["kept"] for r in curve] == [1, 1, 1]
    with pytest.raises(ValueError):
        SC.targets(panel, [0, 0])
    with pytest.raises(ValueError):
        SC.targets(panel, [9])


def test_surrogate_cache(spark, tmp_path):
    panel = G.panel(spark, G.planted())
    path = str(tmp_path / "bank")
    assert J.surrogate_cache(spark, path, panel, 3, 1) == {"hits": 0, "misses": 12}
    assert J.surrogate_cache(spark, path, panel, 4, 1) == {"hits": 12, "misses": 4}
    bank, missed = N.cached(spark, path, panel, 4, 1)
    z = G.planted()[:, 1]
    assert missed == 0 and np.allclose(bank.where("source = 1 AND b = 3").first()["z"], K.surrogate(z, 1, 3, 1))


def test_foils_equal_their_kernels(spark):
    v = G.recovery(3, 360)[:, :3]
    panel = G.panel(spark, v, ["a", "b", "c"])
    coherence, xcorr = rows(X.coherence(panel, 360), "a", "b"), rows(X.xcorr_absmax(panel), "a", "b")
    rho = rows(X.spearman_pairs(panel), "a", "b")
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert np.allclose((coherence[a, b]["coherence_mean"], coherence[a, b]["coherence_peak"]), K.coherence_features(v[:, a], v[:, b]), atol=1e-9)
        assert abs(xcorr[a, b]["xcorr"] - K.xcorr_absmax(v[:, a], v[:, b])) < 1e-9 and abs(rho[a, b]["rho"] - K.spearman(v[:, a], v[:, b])) < 1e-9


def test_text_of_evidence(spark):
    e = spark.createDataFrame([(0, 1, 0.5, 0.25, 0.1, False), (1, 0, 0.9, -0.5, 0.2, False), (2, 0, 0.99, 1.0, 0.3, True)], "target int, source int, coherence_peak double, aligned_gain double, p_value double, certified_candidate boolean")
    assert X.rejected_text(X.top_rejected(e, 1).collect()) == "1<-0: coherence_peak=0.9, aligned_gain=-0.5, p=0.2"
    assert X.asymmetry_text(X.asymmetry(e).collect()) == "0<-1 vs 1<-0: diff=0.75, gains=0.25/-0.5"
