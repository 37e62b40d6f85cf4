"""Settings, their file, their overlay by the environment, and their checks."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

from foldkeep.functions.routing import check_policy
from foldkeep.functions.values import glob_like


@dataclass
class Config:
    shards: int = 64
    logs: int = 1
    quiet_seconds: int = 30
    safety_margin_seconds: int = 300
    jitter_fraction: float = 0.1
    default_eviction_seconds: int = 86400
    min_retention_seconds: int = 3600
    durability: str = "process_crash"
    eviction_overrides: list[tuple[str, int]] = field(default_factory=list)

    def check(self) -> Config:
        if not 0 < self.shards <= 16384 or not 0 < self.logs <= self.shards:
            raise ValueError("shards must be 1 to 16384, and logs no more than shards")
        if self.quiet_seconds <= 0 or self.safety_margin_seconds < 0 or not 0 <= self.jitter_fraction < 1:
            raise ValueError("quiet time must be positive, the margin not negative, the jitter below 1")
        if self.durability not in ("process_crash", "power_loss"):
            raise ValueError("durability is process_crash or power_loss")
        check_policy(self.default_eviction_seconds, self.eviction_overrides)
        if any(s <= self.safety_margin_seconds for s in [self.default_eviction_seconds]):
            raise ValueError("the default eviction time must exceed the safety margin")
        return self

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Config:
        """Defaults, then the JSON (or flat ``name: value``) file, then ``FOLDKEEP_<NAME>`` from the environment."""
        c = cls()
        kinds = {f.name: type(getattr(c, f.name)) for f in fields(cls)}
        if path:
            text = Path(path).read_text()
            found = json.loads(text) if text.lstrip().startswith("{") else dict(x.split(":", 1) for x in (y.split("#")[0].strip() for y in text.splitlines()) if ":" in x)
            for k, v in found.items():
                if k.strip() not in kinds:
                    raise ValueError(f"unknown setting {k}")
                c._put(k.strip(), v, kinds)
        for k, v in (os.environ if env is None else env).items():
            if k.startswith("FOLDKEEP_") and k[9:].lower() in kinds:
                c._put(k[9:].lower(), v, kinds)
        return c.check()

    def _put(self, name, value, kinds):
        if kinds[name] is list:
            value = [tuple(x) for x in (json.loads(value) if isinstance(value, str) else value)]
        elif isinstance(value, str):
            value = kinds[name](value.strip())
        setattr(self, name, value)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in asdict(self).items()], "name string, value string")


def config_get(table: DataFrame, pattern: str) -> DataFrame:
    """CONFIG GET: settings whose name fits the pattern."""
    name: Column = table["name"]
    return table.where(glob_like(name, pattern))
