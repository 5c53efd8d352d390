"""Every query that SQL can express, against DuckDB on the smallest tables; sinks and streams."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lagsieve import oracles
from lagsieve import queries as core
from lagsieve.config import load
from lagsieve.operators import lagged as L
from lagsieve.operators import scale as Z
from lagsieve.operators import screen as SC
from lagsieve.plans import pipelines as J
from lagsieve.sources import panel as sources
from lagsieve.sources import sinks
from lagsieve.streaming import hourly

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.oracles()))
def test_query_equals_its_sql(spark, db, name):
    mine, other = core.queries()[name](spark, SF).toPandas(), db.sql(oracles.oracles()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns) and len(mine) == len(other) > 0
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (mine, other))
    for c in columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), (c, a[~same].head(), b[~same].head())


def test_ecdf_takes_every_order(spark, db):
    """By brute force: each finite p-value of order_edges, whatever the last digit of its order."""
    wanted, groups = [], {}
    for (key,) in db.sql("SELECT o_orderkey FROM orders").fetchall():
        if key % 101:
            x = (key * 37 % 997 + 1) / 998.0
            groups.setdefault(("TRUE", "NULL", "DECOY")[key % 3], []).append(x * x * x * x)
    for kind, p in groups.items():
        wanted += [(kind, x, (i + 1) / len(p)) for i, x in enumerate(sorted(p))]
    mine = sorted(tuple(r) for r in core.queries()["ecdf"](spark, SF).select("edge_type", "x", "y").collect())
    assert [r[0] for r in mine] == [r[0] for r in sorted(wanted)]
    assert [x for r in mine for x in r[1:]] == pytest.approx([x for r in sorted(wanted) for x in r[1:]], abs=1e-6)


def test_pair_queries_take_every_target(spark):
    every = {(a, b) for a in range(5) for b in range(5) if a != b}
    for name in ("own_source_design", "certify_row_perm"):
        assert {tuple(r) for r in core.queries()[name](spark, SF).select("target", "source").distinct().collect()} == every


def test_own_source_design_equals_brute_force(spark):
    z = {(r["ch"], r["t"]): r["z"] for r in core.zpanel(spark, SF).collect()}
    wanted = {}
    for a in range(5):
        for b in set(range(5)) - {a}:
            for u in range(441, 552):
                for k in (1, 2):
                    wanted[a, b, u, f"own[{a}]_lag_{k}"] = (z[a, u], z[a, u - 1 - k])
                    wanted[a, b, u, f"source_{b}[{b}]_lag_{k}"] = (z[a, u], z[b, u - 1 - k])
    rows = core.queries()["own_source_design"](spark, SF).collect()
    mine = {(r["target"], r["source"], r["u"], r["feature"]): (r["y"], r["value"]) for r in rows}
    assert len(rows) == len(mine) and mine.keys() == wanted.keys()
    assert all(mine[k] == pytest.approx(wanted[k], abs=1e-6) for k in wanted)


def test_screen_users_takes_every_target(spark, monkeypatch):
    """Against the one-lag screen of Catalyst over all pairs, also with several blocks."""
    rows = L.pair_lags(Z.scaled(sources.users_hourly(spark, SF, core.HOURS), core.SPLITS))
    wanted = SC.ranked(SC.scores_p1(rows, core.SPLITS, core.ALPHAS)).where("passed_screen").select("target", "source", "screen_rank", "s_screen").collect()
    users = rows.select("ch").distinct().count()
    assert len({r["target"] for r in wanted}) > 5
    for block in (SC.BLOCK, users // 2):
        monkeypatch.setattr(SC, "BLOCK", block)
        mine = core.queries()["screen_users"](spark, SF).select("target", "source", "screen_rank", "s_screen").collect()
        assert {tuple(r)[:3] for r in mine} == {tuple(r)[:3] for r in wanted}
        assert [r["s_screen"] for r in sorted(mine)] == pytest.approx([r["s_screen"] for r in sorted(wanted)], abs=1e-6)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reference_run_writes_its_table_and_summary(spark, tmp_path):
    config = load("smoke").with_(lookback=6, pred_len=1, B=5)
    edges, summary = J.run_reference(spark, config, output=str(tmp_path))
    folder = tmp_path / sinks.run_id(config)
    assert edges.count() == 12 == summary["n_edges"] and set(sinks.LINEAGE) <= set(edges.columns) and len(edges.columns) == 37
    assert sinks.read_summary(spark, str(folder / "summary.json"))["effective_B"] == 5
    sinks.write_tsv(edges.select("target", "source", "p_value"), str(tmp_path / "tsv"))
    assert sinks.read_tsv(spark, str(tmp_path / "tsv")).count() == 12


def test_batch_goes_on_after_a_failure(spark):
    assert J.batch(spark, ["smoke", "nothing", "smoke"], load, lambda c: None).keys() == {"smoke", "nothing"}


def test_stream_of_events(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = hourly.hourly_sums(stream, late="60 days").writeStream.format("memory").queryName("sums").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("sums").select("hour", "channel").collect()) == sorted(hourly.hourly_sums(events).select("hour", "channel").collect())


def test_screen_users_shuffles_no_series_and_breaks_ties_by_source(spark, tmp_path):
    """Copies of users are equal in score but for rounding, and go by source; tasks read blocks from the shared folder instead of shuffled copies of them."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    users = events.agg(F.max("user_id")).first()[0] + 1
    copies = events.crossJoin(spark.range(40).select(F.col("id").alias("copy"))).withColumn("user_id", F.col("user_id") + F.col("copy") * users).drop("copy")
    copies.write.parquet(str(tmp_path / "events.parquet"))
    scores = SC.wide_p1(sources.users_sums(spark, str(tmp_path), core.HOURS), core.SPLITS, core.ALPHAS, str(tmp_path / "blocks"))
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    known = sources.users_sums(spark, SF, core.HOURS).select("ch").distinct().count()
    mine = core.queries()["screen_users"](spark, str(tmp_path)).select("target", "source", "screen_rank").collect()
    first = {r["target"]: r["source"] for r in core.queries()["screen_users"](spark, SF).where("screen_rank = 1").collect()}
    best = {}
    for r in mine:
        best.setdefault(r["target"], {})[r["screen_rank"]] = r["source"]
    assert len(best) == 40 * known
    for target, ranks in best.items():
        assert ranks == {k + 1: first[target % known] + k * known for k in range(4)}, target
