"""Run settings: a frozen dataclass, read from YAML, with a hash; and the registry of known datasets."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

#: Where relative dataset paths start, if set; otherwise data_root of the file.
ROOT_VARIABLE = "LAGSIEVE_DATA_ROOT"
FOLDER = Path(__file__).resolve().parent / "configs"


@dataclass(frozen=True)
class Config:
    data_root: str
    dataset: str
    pred_len: int
    lookback: int
    seed: int
    tier: str
    split_ratios: tuple[float, float, float] = (0.6, 0.2, 0.2)
    stability_blocks: int = 3
    alpha_grid: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0)
    null_method: str = "phase"
    B: int = 20

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


def resolve(name: str) -> Path:
    """A literal path, else one from the repository's root, else a file of the package's configs by its stem."""
    given = Path(name)
    for path in (given, FOLDER.parent.parent / given, FOLDER / f"{given.stem}.yaml"):
        if path.is_file():
            return path
    raise FileNotFoundError(f"no such config: {name}")


def load(name: str) -> Config:
    import yaml

    path = resolve(name)
    raw = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    if missing := sorted({f.name for f in fields(Config)} - raw.keys()):
        raise ValueError(f"{path} lacks {missing}")
    for key, n in (("split_ratios", 3), ("alpha_grid", None)):
        if not isinstance(raw[key], (list, tuple)):
            raise TypeError(f"{key} must be a list")
        if not raw[key] or n and len(raw[key]) != n:
            raise ValueError(f"{key} must have {n or 'some'} values")
    kinds = {"data_root": str, "dataset": str, "tier": str, "null_method": str}
    values = {f.name: tuple(float(x) for x in raw[f.name]) if f.name in ("split_ratios", "alpha_grid") else kinds.get(f.name, int)(raw[f.name]) for f in fields(Config)}
    return Config(**values | {"data_root": os.environ.get(ROOT_VARIABLE, values["data_root"])})


def config_hash(config: Config) -> str:
    text = json.dumps(asdict(config), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:16]


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    kind: str  # ETT_hour, ETT_minute, Custom or synthetic: decides the borders
    channels: int | None
    target: str = "OT"
    features: str = "M"


# The known datasets.
DATASETS = {
    d.name: d
    for d in (
        Dataset("ETTh1", "ETT-small/ETTh1.csv", "ETT_hour", 7),
        Dataset("ETTh2", "ETT-small/ETTh2.csv", "ETT_hour", 7),
        Dataset("ETTm1", "ETT-small/ETTm1.csv", "ETT_minute", 7),
        Dataset("ETTm2", "ETT-small/ETTm2.csv", "ETT_minute", 7),
        Dataset("Weather", "weather/weather.csv", "Custom", 21),
        Dataset("smoke", "", "synthetic", 4, target="x0"),
        Dataset("synthetic_planted", "", "synthetic", 4, target="target"),
    )
}


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(DATASETS))}")
    return DATASETS[name]


def dataset_path(root: str, info: Dataset) -> str:
    if os.path.isabs(info.path):
        raise ValueError(f"{info.name}: the path must be relative")
    return f"{root.rstrip('/')}/{info.path}"
