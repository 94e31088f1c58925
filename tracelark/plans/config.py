"""The JSON configuration of a batch of projects."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Artifacts:
    path: str
    type: str = "TEXTUAL"


@dataclass(frozen=True)
class Project:
    name: str
    source: Artifacts
    target: Artifacts
    gold_standard_path: str | None = None
    intermediate: Artifacts | None = None
    #: Folder with pair files for source, intermediate and target in place of biterms found in the texts.
    pairs: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    projects: tuple[Project, ...]
    do_evaluate: bool = True
    ir_method: str = "VSM"
    #: Whether to run the full pipeline; its settings follow.
    full: bool = False
    #: share, top_k, max_repeat, max_pairs, min_agree of the enrichment; values that are no number give the default.
    enrichment: dict = field(default_factory=dict)
    strategy: str = "avg"
    guard: bool = False
    transitivity: bool = True

    @staticmethod
    def of(raw: dict) -> Config:
        part = lambda x: None if x is None else Artifacts(x["path"], x.get("type", "TEXTUAL"))
        projects = tuple(Project(p["name"], part(p["source"]), part(p["target"]), p.get("goldStandardPath"), part(p.get("intermediate")), p.get("pairs", {})) for p in raw.get("projects", ()))
        return Config(projects, bool(raw.get("doEvaluate", True)), raw.get("irMethod", "VSM"), bool(raw.get("runTriad", False)), dict(raw.get("enrichment", {})), raw.get("fusionStrategy", "avg"), bool(raw.get("fusionGuard", False)), bool(raw.get("transitivity", True)))

    @staticmethod
    def load(path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return Config.of(json.load(f))
