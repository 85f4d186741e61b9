"""Stages over artifacts: validated order, fingerprints, and runs that skip what is already done.

A stage's result is a Parquet table named by its fingerprint (its configuration and those it depends on, and the
sources), so a rerun reads what exists, and a failed run leaves what it finished.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators.items import measured
from curatrix.operators.numbering import numbered
from curatrix.operators.rules import LONG, SHORT, all_findings
from curatrix.operators.triage import buckets, per_item, urgency
from curatrix.sources.shared import exists

Make = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Stage:
    id: str
    make: Make
    requires: tuple[str, ...] = ()
    produces: str = ""
    config: dict = field(default_factory=dict, hash=False)
    ram_mb: int = 0
    disk_mb: int = 0


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def validate(stages: list[Stage], given: tuple[str, ...] = ()) -> None:
    have: set[str] = set(given)
    for k, s in enumerate(stages):
        if not s.id or any(s.id == t.id for t in stages[:k]):
            raise ValueError(f"stage {k} has no id of its own")
        if missing := set(s.requires) - have:
            raise ValueError(f"{s.id} requires {sorted(missing)}, which nothing before it produces")
        if s.produces in have:
            raise ValueError(f"{s.produces} is produced twice")
        have.add(s.produces)


def fingerprints(stages: list[Stage], source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    made = {}
    for s in stages:
        made[s.produces] = out[s.id] = digest([s.id, s.config, source, [made.get(r, "") for r in s.requires]])
    return out


def source_digest(files: DataFrame) -> str:
    """A digest of what sources hold (path, sha), whatever their order: count, sum and parity of their hashes, partial on each task."""
    h = F.xxhash64("path", "sha")
    r = files.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(path, sha))").alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return digest([r.n, r.x, str(r.s)])


def estimate(stages: list[Stage], todo: list[tuple[str, str, str]]) -> dict[str, int]:
    """What the stages that would run declare: disk in all, the most memory of one."""
    due = [s for s, t in zip(stages, todo, strict=True) if t[1] == "run"]
    return {"stages": len(due), "disk_mb": sum(s.disk_mb for s in due), "ram_mb": max((s.ram_mb for s in due), default=0)}


def plan(spark: SparkSession, stages: list[Stage], folder: str, source: str, forced: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """(stage, "run" or "skip", path) in order; a stage runs if it is forced, has no result, or depends on one that runs."""
    prints, out, running = fingerprints(stages, source), [], set()
    for s in stages:
        path = f"{folder}/{s.id}-{prints[s.id][:24]}"
        run = s.id in forced or not exists(spark, f"{path}/_SUCCESS") or any(r in running for r in s.requires)
        if run:
            running.add(s.produces)
        out.append((s.id, "run" if run else "skip", path))
    return out


def run(spark: SparkSession, stages: list[Stage], folder: str, source: str, inputs: dict[str, DataFrame], forced: tuple[str, ...] = (), ram_limit_mb: int = 0) -> dict[str, DataFrame]:
    """All artifacts, of stages that ran now and of those that were read."""
    validate(stages, tuple(inputs))
    todo = plan(spark, stages, folder, source, forced)
    need = estimate(stages, todo)["ram_mb"]
    if ram_limit_mb and need > ram_limit_mb:
        raise MemoryError(f"a stage declares {need} MB; {ram_limit_mb} are allowed")
    have = dict(inputs)
    for s, (_, what, path) in zip(stages, todo, strict=True):
        if what == "run":
            s.make(spark, have).write.mode("overwrite").parquet(path)
        have[s.produces] = spark.read.parquet(path)
    return have


#: Memory that the default stages declare, in MB.
RAM = {"scan": 64, "analysis": 256, "recommend": 128, "review": 256}


def default_stages(short: int = SHORT, long: int = LONG) -> list[Stage]:
    """From records (doc_id, text, source) to items, their findings, recommendations and the order of review."""

    def review(_: SparkSession, have: dict[str, DataFrame]) -> DataFrame:
        per = have["recommendations"].withColumn("decided", F.lit(False))
        return numbered(per.filter("bucket <> 'READY_FOR_TRAINING'"), *urgency(per), name="place").select("item_id", "bucket", "reason", "place")

    return [
        Stage("scan", lambda _, have: measured(have["records"]).drop("text"), ("records",), "items", ram_mb=RAM["scan"]),
        Stage("analysis", lambda _, have: all_findings(have["items"], short, long), ("items",), "findings", {"short": short, "long": long}, RAM["analysis"]),
        Stage("recommend", lambda _, have: buckets(per_item(have["items"], have["findings"])), ("items", "findings"), "recommendations", ram_mb=RAM["recommend"]),
        Stage("review", review, ("recommendations",), "queue", ram_mb=RAM["review"]),
    ]


#: Session settings by profile of resources.
PROFILES = {
    "eco": {"spark.sql.shuffle.partitions": "64", "spark.sql.files.maxPartitionBytes": "64m"},
    "balanced": {"spark.sql.shuffle.partitions": "400", "spark.sql.files.maxPartitionBytes": "128m"},
    "max": {"spark.sql.shuffle.partitions": "4000", "spark.sql.files.maxPartitionBytes": "256m"},
}


def apply_profile(spark: SparkSession, name: str) -> None:
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **PROFILES[name]}.items():
        spark.conf.set(k, v)


class Registry:
    """Transforms by name: metadata, parameters with defaults, dependencies, and whether they are enabled."""

    def __init__(self) -> None:
        self._have: dict[str, tuple[Callable[..., DataFrame], dict, tuple[str, ...]]] = {}
        self._off: set[str] = set()

    def register(self, name: str, transform: Callable[..., DataFrame], defaults: dict | None = None, requires: tuple[str, ...] = ()) -> None:
        if name in self._have:
            raise ValueError(f"{name} is registered already")
        self._have[name] = (transform, dict(defaults or {}), requires)

    def enable(self, name: str, on: bool = True) -> None:
        if name not in self._have:
            raise KeyError(name)
        (self._off.discard if on else self._off.add)(name)

    def names(self) -> list[str]:
        return [n for n in self._have if n not in self._off]

    def apply(self, name: str, df: DataFrame, **config: object) -> DataFrame:
        transform, defaults, requires = self._have[name]
        if name in self._off or any(r not in self.names() for r in requires):
            raise RuntimeError(f"{name} or what it requires isn't enabled")
        if unknown := set(config) - set(defaults):
            raise TypeError(f"{name} has no parameters {sorted(unknown)}")
        return transform(df, **{**defaults, **config})
