"""Business rules: typed parameters with the fingerprint of the text they came from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from movewell.fixed_values import DEFAULT_RULES


@dataclass(frozen=True)
class Rules:
    percent: float
    min_activities: int
    max_walk_km: float
    max_bike_km: float
    window_days: int

    @classmethod
    def from_mapping(cls, settings: Mapping[str, Any]) -> Rules:
        wellness, limits = settings["bien_etre"], settings["distance"]
        return cls(
            percent=float(settings["prime_sportive"]["percent"]),
            min_activities=int(wellness["min_activities"]),
            max_walk_km=float(limits["max_walk_km"]),
            max_bike_km=float(limits["max_bike_km"]),
            window_days=int(wellness.get("window_days", 365)),
        )


DEFAULT = Rules.from_mapping(DEFAULT_RULES)


def read_bytes(path: str, spark: SparkSession | None = None) -> bytes:
    """A small file: with a session as Spark finds the path, in shared storage too, else a local one."""
    if spark is not None:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as file:
        return file.read()


def load_rules(path: str, spark: SparkSession | None = None) -> tuple[Rules, str]:
    """Read a YAML or JSON rules file; the fingerprint is the md5 of its bytes.

    With a session the path is Spark's: in shared storage, or local as file:///...
    """
    raw = read_bytes(path, spark)
    if path.endswith(".json"):
        settings = json.loads(raw)
    else:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("YAML rules need PyYAML; write them as JSON instead") from missing
        settings = yaml.safe_load(raw)
    return Rules.from_mapping(settings), hashlib.md5(raw).hexdigest()
