"""The configuration of a run: six sections, read from and written to YAML."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

import yaml


# The keys and defaults of the six sections are the public form of a config.
@dataclass
class DatasetConfig:
    type: str = "file"
    path: str | None = None
    format: str = "raw"
    columns: list[str] | None = None


@dataclass
class PreprocessingConfig:
    log_pattern: str
    timestamp_format: str | None = None
    strict_mode: bool = False
    require_timestamps: bool = True


@dataclass
class ParsingConfig:
    similarity_threshold: float = 0.4
    depth: int = 4
    max_children: int = 100
    max_clusters: int = 1024
    extra_delimiters: list[str] = field(default_factory=lambda: ["_"])
    masking_rules: list[dict[str, str]] = field(default_factory=list)
    mask_prefix: str = "<:"
    mask_suffix: str = ":>"
    mine: str = "masked"


@dataclass
class WindowingConfig:
    """A null setting takes the default that the strategy documents."""

    strategy: str = "fixed"
    window_size: str = "5m"
    step_size: str | None = None
    session_timeout: str | None = None
    target_logs_per_window: int | None = None
    min_window_size: str | None = None
    max_window_size: str | None = None


@dataclass
class AnomalyConfig:
    algorithm: str = "pca_subspace"
    variance_threshold: float = 0.95
    alpha: float = 0.001
    use_tfidf: bool = False
    use_scaling: bool = True


@dataclass
class OutputConfig:
    directory: str = "results"
    save_intermediate: bool = True
    formats: list[str] = field(default_factory=lambda: ["parquet"])


@dataclass
class PipelineConfig:
    dataset: DatasetConfig
    preprocessing: PreprocessingConfig
    parsing: ParsingConfig = field(default_factory=ParsingConfig)
    windowing: WindowingConfig = field(default_factory=WindowingConfig)
    anomaly_detection: AnomalyConfig = field(default_factory=AnomalyConfig)
    output: OutputConfig = field(default_factory=OutputConfig)


_SECTIONS = {
    "dataset": DatasetConfig,
    "preprocessing": PreprocessingConfig,
    "parsing": ParsingConfig,
    "windowing": WindowingConfig,
    "anomaly_detection": AnomalyConfig,
    "output": OutputConfig,
}


def config_from(data: dict[str, Any]) -> PipelineConfig:
    """A config of plain sections. Unknown keys are errors; without a dataset it is "inline"."""
    data = {"dataset": {"type": "inline"}} | data
    if unknown := set(data) - set(_SECTIONS):
        raise ValueError(f"Unknown sections: {sorted(unknown)}")
    return PipelineConfig(**{name: _SECTIONS[name](**(section or {})) for name, section in data.items()})


def load_config(path: str | Path) -> PipelineConfig:
    """Read a YAML file; relative dataset and output paths are relative to its folder."""
    path = Path(path)
    config = config_from(yaml.safe_load(path.read_text()) or {})
    for section, key in ((config.dataset, "path"), (config.output, "directory")):
        value = getattr(section, key)
        if value and "://" not in value and not Path(value).is_absolute():
            setattr(section, key, str((path.parent / value).resolve()))
    return config


def save_config(config: PipelineConfig, path: str | Path) -> None:
    Path(path).write_text(yaml.safe_dump(asdict(config), sort_keys=False))
