"""Corpus configuration: TOML files merged over defaults."""

from __future__ import annotations

import copy
import datetime
import os
import tomllib
from dataclasses import dataclass
from pathlib import Path

DEFAULTS: dict = {
    "title": "", "packs": [],
    "dates": {"min_year": 1900, "max_year": 0, "text_min_year": 0, "text_max_year": 0, "two_digit_century": 1900},
    "extract": {"include": [], "exclude": [], "archives": True, "archive_members": [], "max_file_mb": 500, "text_page_chars": 12_000},
    "index": {"ner": False, "codenames": True, "identifiers": True, "allcaps_matching": True, "window": 5, "max_window_entities": 400, "min_edge_docs": 2, "min_candidate_docs": 2, "suppress_aliases": [], "keep_aliases": []},
    "metadata": {"collection_depth": 1, "collection_aliases": {}, "publisher_rules": [], "origin_rules": [], "html_origin": "", "default_origin": "", "title_strip": ""},
    "ui": {"hide_hubs": 800}, "records": [],
}


def deep_merge(base: dict, over: dict) -> dict:
    """Tables merge key by key; anything else, lists too, replaces."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def resolve_path(text: str, base: str | Path) -> Path:
    """~ and environment variables expanded; relative to base."""
    path = Path(os.path.expandvars(os.path.expanduser(text)))
    return path if path.is_absolute() else Path(base) / path


@dataclass(frozen=True)
class CorpusConfig:
    id: str
    data: dict

    def __getitem__(self, section: str):
        return self.data[section]

    @property
    def root(self) -> str:
        return self.data.get("root", "")


def from_dict(corpus_id: str, settings: dict, today: datetime.date | None = None) -> CorpusConfig:
    """Defaults, the settings, and what follows from them: the last year is this
    one, text bounds are the corpus' bounds, archive members are of known formats."""
    from sextant.sources.discover import FORMATS

    data = deep_merge(DEFAULTS, settings)
    dates = data["dates"]
    dates["max_year"] = dates["max_year"] or (today or datetime.date.today()).year
    dates["text_min_year"] = dates["text_min_year"] or dates["min_year"]
    dates["text_max_year"] = dates["text_max_year"] or dates["max_year"]
    if not data["extract"]["archive_members"]:
        data["extract"]["archive_members"] = sorted(FORMATS)
    return CorpusConfig(settings.get("id", corpus_id), data)


def load(name: str, folder: str | Path = "corpora") -> CorpusConfig:
    """A corpus by name or by the path of its file."""
    path = Path(name) if name.endswith(".toml") else Path(folder) / f"{name}.toml"
    if not path.exists():
        known = ", ".join(sorted(p.stem for p in Path(folder).glob("*.toml") if p.stem[0] not in "_."))
        raise KeyError(f"no corpus {name!r}; known: {known or 'none'}")
    with path.open("rb") as f:
        return from_dict(path.stem, tomllib.load(f))


def load_all(folder: str | Path = "corpora") -> tuple[list[CorpusConfig], dict[str, str]]:
    """All corpora, and the errors of files that do not load; _ and . files are skipped."""
    found, errors = [], {}
    for path in sorted(Path(folder).glob("*.toml")):
        if path.stem[0] in "_.":
            continue
        try:
            found.append(load(str(path)))
        except (tomllib.TOMLDecodeError, KeyError, TypeError, ValueError) as e:
            errors[path.stem] = str(e)
    return found, errors


class Watched:
    """Configurations that are read again when a file changes."""

    def __init__(self, folder: str | Path):
        self.folder, self.stamp, self.value = Path(folder), None, ([], {})

    def get(self) -> tuple[list[CorpusConfig], dict[str, str]]:
        stamp = sorted((p.name, p.stat().st_mtime_ns) for p in self.folder.glob("*.toml"))
        if stamp != self.stamp:
            self.stamp, self.value = stamp, load_all(self.folder)
        return self.value
