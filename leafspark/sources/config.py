"""Settings as frozen dataclasses, with JSON or YAML files and environment overrides."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from leafspark.operators.preprocess import PreprocessOptions

PREFIX = "LEAFSPARK_"


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class SplitterOptions:
    split_levels: tuple[int, ...] = (1, 2, 3)
    max_tokens_per_chunk: int = 1000

    def __post_init__(self) -> None:
        object.__setattr__(self, "split_levels", tuple(self.split_levels))
        _require(self.max_tokens_per_chunk >= 1, "max_tokens_per_chunk must be at least 1")


@dataclass(frozen=True)
class EmbedderOptions:
    model: str = "embeddinggemma"
    cache_enabled: bool = True
    cache_max_size: int = 1000
    batch_size: int = 10
    memory_threshold_mb: int = 1500

    def __post_init__(self) -> None:
        _require(self.cache_max_size >= 1 and self.batch_size >= 1 and self.memory_threshold_mb > 0, "sizes must be positive")


@dataclass(frozen=True)
class ReorderOptions:
    strategy: str = "sequential"
    similarity_threshold: float = 0.5

    def __post_init__(self) -> None:
        _require(self.strategy in ("sequential", "cluster"), "strategy is sequential or cluster")
        _require(0 <= self.similarity_threshold <= 1, "similarity_threshold is within 0 and 1")


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 5
    min_similarity: float = 0.5
    output_format: str = "text"

    def __post_init__(self) -> None:
        _require(self.top_k > 0 and 0 <= self.min_similarity <= 1, "top_k > 0 and min_similarity within 0 and 1")
        _require(self.output_format in ("text", "json"), "output_format is text or json")


@dataclass(frozen=True)
class DedupOptions:
    similarity_threshold: float = 0.85
    strategy: str = "first"
    use_llm: bool = False
    dry_run: bool = False

    def __post_init__(self) -> None:
        _require(0 <= self.similarity_threshold <= 1, "similarity_threshold is within 0 and 1")
        _require(self.strategy in ("first", "longest", "best_metadata"), "unknown strategy")


@dataclass(frozen=True)
class Settings:
    preprocessor: PreprocessOptions = field(default_factory=PreprocessOptions)
    splitter: SplitterOptions = field(default_factory=SplitterOptions)
    embedder: EmbedderOptions = field(default_factory=EmbedderOptions)
    reorder: ReorderOptions = field(default_factory=ReorderOptions)
    search: SearchOptions = field(default_factory=SearchOptions)
    dedup: DedupOptions = field(default_factory=DedupOptions)

    @classmethod
    def from_dict(cls, data: dict) -> Settings:
        """Unknown sections and keys are errors."""
        kinds = {f.name: f.default_factory for f in dataclasses.fields(cls)}
        if bad := data.keys() - kinds.keys():
            raise ValueError(f"unknown sections: {sorted(bad)}")
        return cls(**{k: kinds[k](**v) for k, v in data.items()})


def load(path: str | None = None) -> Settings:
    """Settings of a .json or .yaml file; sections that the file holds can be overridden by LEAFSPARK_SECTION_KEY."""
    if path is None:
        here = [Path("leafspark.yaml"), Path("leafspark.json"), Path.home() / ".config/leafspark/leafspark.yaml"]
        found = next((p for p in here if p.exists()), None)
        if found is None:
            return Settings()
    else:
        found = Path(path)
    if not found.exists():
        raise FileNotFoundError(found)
    if found.suffix == ".json":
        data = json.loads(found.read_text("utf-8"))
    elif found.suffix in (".yaml", ".yml"):
        import yaml

        data = yaml.safe_load(found.read_text("utf-8"))
    else:
        raise ValueError(f"not a .json or .yaml file: {found}")
    if not isinstance(data, dict):
        raise ValueError("the settings are not a mapping")
    for name, text in os.environ.items():
        if name.startswith(PREFIX):
            section, _, key = name[len(PREFIX) :].lower().partition("_")
            if section in data:
                try:
                    data[section][key] = json.loads(text)
                except ValueError:
                    data[section][key] = text
    return Settings.from_dict(data)


def save(settings: Settings, path: str) -> None:
    data = dataclasses.asdict(settings)
    p = Path(path)
    if p.suffix == ".json":
        p.write_text(json.dumps(data, indent=2, ensure_ascii=False), "utf-8")
    elif p.suffix in (".yaml", ".yml"):
        import yaml

        p.write_text(yaml.safe_dump(json.loads(json.dumps(data)), sort_keys=False, allow_unicode=True), "utf-8")
    else:
        raise ValueError(f"not a .json or .yaml file: {path}")
