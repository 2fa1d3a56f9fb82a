"""Settings with their defaults (fixed values), and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from boxtrail.errors import ConfigError, SchemaError
from boxtrail.operators.tracking import TrackerConfig

#: How trackers call themselves.
METHODS = {"sort": "SORT", "kalman": "Kalman Filter", "two_pass": "Two-pass"}


def method_name(config: TrackerConfig) -> str:
    return METHODS[config.kind]


@dataclass(frozen=True)
class DetectorConfig:
    confidence: float = 0.5
    max_detections: int | None = None  # a top-k by picture, off unless asked for
    input_width: int = 640
    input_height: int = 640


@dataclass(frozen=True)
class PipelineConfig:
    tile: int = 640
    overlap: int = 64
    classes: list[int] = field(default_factory=lambda: [2, 3, 4, 7])
    iou_threshold: float = 0.5
    nested_padding: float = 10.0

    def __post_init__(self):
        if not 0 <= self.overlap < self.tile:
            raise ConfigError("the overlap of tiles must be smaller than a tile")
        if not 0 <= self.iou_threshold <= 1:
            raise ConfigError("the overlap threshold lies between 0 and 1")


@dataclass(frozen=True)
class StreamConfig:
    files_per_trigger: int = 2
    late: str = "10 seconds"
    tick_ms: int = 20


#: The settings of the video command.
VIDEO_PIPELINE = PipelineConfig(overlap=32, classes=[0, 2, 3, 4, 7])


def require_keys(config: dict, keys: tuple[str, ...] = ("path", "train", "nc", "names")) -> None:
    """A dataset's description must have these."""
    missing = [k for k in keys if k not in config]
    if missing:
        raise ConfigError(f"missing: {', '.join(missing)}")


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df
