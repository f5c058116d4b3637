"""Build settings and dataset descriptions, read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

SPLIT_KEYS = ("train", "val", "valid", "test")


@dataclass(frozen=True)
class SourcePolicy:
    name: str
    root: str
    class_map: dict[int, int]
    unsupported: frozenset[int] = frozenset()
    negative: frozenset[int] = frozenset()
    preserve_empty: bool = False
    reject_other_formats: bool = True
    exclude_unsupported: bool = True


@dataclass(frozen=True)
class BuildConfig:
    seed: int
    valid_fraction: float
    negative_fraction: float
    priority: tuple[str, ...]
    sources: dict[str, SourcePolicy]
    benchmarks: tuple[str, ...] = ()
    duplicate_mode: str = "exact_dhash_dimensions"
    classes: tuple[str, ...] = field(default=())

    def class_rows(self) -> list[tuple]:
        rows = []
        for s in self.sources.values():
            rows += [(s.name, c, t, "target") for c, t in s.class_map.items()]
            rows += [(s.name, c, None, "negative") for c in s.negative]
            rows += [(s.name, c, None, "unsupported") for c in s.unsupported]
        return sorted(rows, key=lambda r: (r[0], r[1]))

    def class_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.class_rows(), "source string, source_class int, target_class int, role string")


def load_text(text: str) -> dict:
    """JSON, or YAML where a YAML reader is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def build_config(data: dict, project: str = ".") -> BuildConfig:
    """A typed config from a mapping; keys of class maps become integers, roots absolute."""
    sources = {}
    for name, s in data["sources"].items():
        root = PurePosixPath(s["root"])
        sources[name] = SourcePolicy(
            name, str(root if root.is_absolute() else PurePosixPath(project) / root),
            {int(k): int(v) for k, v in s.get("class_map", {}).items()},
            frozenset(map(int, s.get("unsupported_class_ids", ()))), frozenset(map(int, s.get("negative_class_ids", ()))),
            bool(s.get("preserve_empty_labels", False)), bool(s.get("reject_non_detection_labels", True)),
            bool(s.get("exclude_if_any_unsupported", True)),
        )
    config = BuildConfig(
        int(data["seed"]), float(data["valid_fraction"]), float(data["max_negative_fraction"]), tuple(data["source_priority"]), sources,
        tuple(data.get("benchmarks", ())), data.get("duplicate_mode", "exact_dhash_dimensions"), tuple(data.get("classes", ())),
    )
    if config.duplicate_mode != "exact_dhash_dimensions":
        raise ValueError(f"unknown duplicate mode {config.duplicate_mode}")
    if missing := set(config.priority) ^ set(sources):
        raise ValueError(f"sources and priority differ: {sorted(missing)}")
    return config


def split_paths(description: dict, root: str, exists) -> dict[str, list[str]]:
    """The folders of each split of a dataset description: as given if absolute, else below
    ``path`` of the description, else below the root without leading ``.`` and ``..``."""
    base = PurePosixPath(root) / str(description.get("path", ""))
    out: dict[str, list[str]] = {}
    for key in SPLIT_KEYS:
        raw = description.get(key)
        if raw is None:
            continue
        found = []
        for item in raw if isinstance(raw, list) else [raw]:
            p = PurePosixPath(item)
            parts = [x for x in p.parts if x not in (".", "..")]
            tried = [str(p)] if p.is_absolute() else [str(base / p), str(PurePosixPath(root).joinpath(*parts))]
            found.append(next((t for t in tried if ".." not in PurePosixPath(t).parts and exists(t)), tried[-1]))
        out["valid" if key == "val" else key] = found
    return out
