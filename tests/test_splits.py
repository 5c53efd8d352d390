import pytest

from lagsieve import config
from lagsieve.plans import splits as S
from lagsieve.sources import panel


@pytest.mark.parametrize(
    "kind, rows, wanted",
    [
        ("ETT_hour", 17420, [(0, 8640), (8544, 11520), (11424, 14400)]),
        ("ETT_minute", 69680, [(0, 34560), (34464, 46080), (45984, 57600)]),
        ("Custom", 52696, [(0, 36887), (36791, 42157), (42061, 52696)]),
    ],
)
def test_borders(kind, rows, wanted):
    assert [(r.start, r.end) for r in S.borders(kind, rows, 96)] == wanted


def test_carve_stays_before_the_test_window():
    s = S.splits_for("synthetic", 720, 24)
    assert [(r.start, r.end) for r in s.roles().values()] == [(0, 331), (331, 441), (441, 552)]
    assert s.pre_test.end == 552 and not any(r.overlaps(s.test) for r in (*s.roles().values(), *s.blocks))
    assert [(b.start, b.end) for b in s.blocks] == [(0, 184), (184, 368), (368, 552)]
    assert [b.cert.length for b in S.cert_blocks(s, 3)] == [37, 37, 37]


def test_bad_splits():
    for ratios in ((0.5, 0.3, 0.3), (0.6, 0.4, 0.0), (0.5, 0.5)):
        with pytest.raises(ValueError):
            S.splits_for("synthetic", 720, 24, ratios)
    for a, b in ((-1, 2), (3, 2)):
        with pytest.raises(ValueError):
            S.Range(a, b)
    with pytest.raises(ValueError):
        S.borders("other", 100, 5)
    with pytest.raises(ValueError):
        S.equal_blocks(S.Range(0, 2), 3)


def test_configs_load_and_hash(monkeypatch, tmp_path):
    c = config.load("smoke")
    assert (c.lookback, c.pred_len, c.B) == (24, 96, 20) and len(config.config_hash(c)) == 16
    assert config.config_hash(c) != config.config_hash(c.with_(B=21))
    monkeypatch.setenv(config.ROOT_VARIABLE, "/elsewhere")
    assert config.load("etth1_pl96.yaml").data_root == "/elsewhere"
    bad = tmp_path / "bad.yaml"
    bad.write_text("dataset: smoke\n")
    with pytest.raises(ValueError, match="alpha_grid"):
        config.load(str(bad))
    with pytest.raises(FileNotFoundError):
        config.load("nothing")
    with pytest.raises(KeyError, match="Weather"):
        config.dataset("other")
    assert len(list(config.FOLDER.glob("*.yaml"))) == 22


def weather_like(tmp_path, rows=720):
    names = [f"c{j}" for j in range(20)] + ["OT"]
    lines = [",".join(["OT", "date", *names[:-1]])]
    for i in range(rows):
        lines.append(",".join([str(i + 20), f"2020-{1 + i // 672:02d}-{1 + i // 24 % 28:02d} {i % 24:02d}:00:00", *[str(i + j) for j in range(20)]]))
    (tmp_path / "weather").mkdir()
    (tmp_path / "weather/weather.csv").write_text("\n".join(lines))
    return config.Config(str(tmp_path), "Weather", 24, 24, 0, "sanity")


def test_csv_panel_has_no_row_of_the_test_window(spark, tmp_path):
    df, s = panel.load(spark, weather_like(tmp_path))
    assert df.agg({"t": "max"}).first()[0] == s.pre_test.end - 1 and df.select("ch").distinct().count() == 21
    assert {r["ch"]: r["channel"] for r in df.where("t = 0").collect()}[20] == "OT"
    fit = df.where(f"t < {s.train_fit.end}").groupBy("ch").agg({"z": "avg"}).collect()
    assert all(abs(r[1]) < 1e-9 for r in fit)


def test_channel_order():
    info = config.Dataset("x", "x.csv", "Custom", None)
    assert panel.channel_order(["OT", "date", "a", "b"], info) == ["a", "b", "OT"]
    assert panel.channel_order(["date", "a", "OT"], config.Dataset("x", "x", "ETT_hour", None, features="S")) == ["OT"]
    with pytest.raises(ValueError):
        panel.channel_order(["a", "OT"], info)
