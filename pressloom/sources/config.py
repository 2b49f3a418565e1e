"""Configuration files, run folders and logs: driver-side, small."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass
from logging.handlers import RotatingFileHandler
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUN_ID = re.compile(r"[A-Za-z0-9_.-]+")


def resolve(name: str, root: str = ".") -> Path:
    """A configuration file as named, below the root, or in its ``configs`` folder."""
    raw = Path(name)
    tried = [raw, Path(root) / raw, *([Path(root) / "configs" / raw] if len(raw.parts) == 1 else [])]
    for p in tried:
        if p.exists():
            return p.resolve()
    raise FileNotFoundError(f"no configuration {name}; tried " + ", ".join(map(str, tried)))


def load_yaml(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text("utf-8")) or {}


def expected_sources(spark: SparkSession, config: dict) -> DataFrame:
    """(source, country, domain) of the sources that a configuration lists."""
    rows = [tuple(str(s.get(k) or "") for k in ("name", "country", "domain")) for s in config.get("sources") or []]
    return spark.createDataFrame(rows, "source string, country string, domain string")


def run_id(value: str | None) -> str | None:
    """A run's name, None for a blank one. Raises on other characters than letters, digits, ``_.-``."""
    value = (value or "").strip()
    if value and not RUN_ID.fullmatch(value):
        raise ValueError(f"bad run id {value!r}")
    return value or None


@dataclass(frozen=True)
class RunPaths:
    """Where the tables of a run are; without a run, below ``data`` itself. ``root`` may be the address of any store."""

    root: str
    run: str | None = None

    @property
    def base(self) -> str:
        return f"{self.root}/data/runs/{self.run}" if self.run else f"{self.root}/data"

    @property
    def reports(self) -> str:
        return f"{self.root}/outputs/reports" + (f"/{self.run}" if self.run else "")

    def table(self, stage: str) -> str:
        return {
            "cdx": f"{self.base}/raw_cdx/cdx_snapshots.parquet",
            "homepage": f"{self.base}/candidates/homepage_candidates.parquet",
            "clean": f"{self.base}/candidates/clean_candidates.parquet",
            "articles": f"{self.base}/extracted_text/articles_text.parquet",
            "retry": f"{self.reports}/articles_text_retry_summary.csv",
            "classify": f"{self.base}/processed/articles_classified.parquet",
            "diagnostics": f"{self.reports}/homepage_snapshot_diagnostics_summary.csv",
        }[stage]


def logger(name: str, folder: str, level: int = logging.INFO) -> logging.Logger:
    """Writes to the console and to a file that turns over at 5 MB; asked for twice, it is the same one."""
    log = logging.getLogger(name)
    if not log.handlers:
        Path(folder).mkdir(parents=True, exist_ok=True)
        log.setLevel(level)
        for handler in (logging.StreamHandler(), RotatingFileHandler(Path(folder) / f"{name}.log", maxBytes=5_000_000, backupCount=3, encoding="utf-8")):
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
            log.addHandler(handler)
    return log
