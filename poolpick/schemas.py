"""The dataset registry (SRC-11).

The registry is small driver-side metadata (metric name, label names, raw
columns to drop, task type, source/target columns) read from YAML; it
only parameterises DataFrame operations, it never holds data.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

REGISTRY = os.path.join(os.path.dirname(os.path.abspath(__file__)), "datasets.yaml")


@dataclass
class DatasetConfig:
    name: str
    metric: str | None = None
    label_names: list[str] = field(default_factory=list)
    remove_columns: list[str] | None = None
    task_type: str | None = None
    source_data_column: str | None = None
    target_data_column: str | None = None


def load_registry(path: str) -> dict[str, DatasetConfig]:
    """YAML mapping of dataset name -> settings (a later duplicate name wins)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    fields = DatasetConfig.__dataclass_fields__
    return {name: DatasetConfig(name=name, **{k: v for k, v in (body or {}).items() if k in fields})
            for name, body in raw.items()}


def drop_for(df: DataFrame, cfg: DatasetConfig, keep: list[str]) -> DataFrame:
    """PRJ-2 driven by the registry: drop the listed raw columns, or, when the entry
    lists none, every column that is not in ``keep``."""
    if cfg.remove_columns is None:
        return df.select(*keep)
    return df.drop(*cfg.remove_columns)
