"""Knowledge packs: entities, themes and rules, and the algebra that merges them.

The engine ships the format and a small invented pack; lists of real names are
the user's own data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.matcher import case_sensitive
from sextant.operators.themes import MIN_HITS, Theme


@dataclass(frozen=True)
class OriginRule:
    """label applies where pattern is found in target (path, top or head) and unless is not."""

    pattern: str
    label: str
    priority: int = 50
    target: str = "head"
    unless: str | None = None


@dataclass(frozen=True)
class ClassificationRule:
    pattern: str
    label: str
    priority: int = 50


@dataclass(frozen=True)
class Pack:
    """entities: (type, name, aliases, description).  date_hints: (priority, text
    column -> date column).  metadata: hooks DataFrame -> DataFrame, run in order."""

    name: str
    requires: tuple[str, ...] = ()
    entities: tuple[tuple[str, str, tuple[str, ...], str], ...] = ()
    descriptions: dict[str, str] = field(default_factory=dict)
    themes: tuple[Theme, ...] = ()
    min_hits: int | None = None
    strip: tuple[str, ...] = ()
    stop: tuple[str, ...] = ()
    markings: tuple[str, ...] = ()
    suppress: tuple[str, ...] = ()
    origins: tuple[OriginRule, ...] = ()
    classifications: tuple[ClassificationRule, ...] = ()
    date_hints: tuple[tuple[int, Callable[[Column], Column]], ...] = ()
    published: tuple[Callable[[Column], Column], ...] = ()
    metadata: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    presets: tuple[dict, ...] = ()


def alias_identity(alias: str) -> str:
    return alias if case_sensitive(alias) else alias.lower()


def order(names: list[str], known: dict[str, Pack]) -> list[str]:
    """Packs with what they require before them."""
    done: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError("packs require each other: " + " -> ".join((*path, name)))
        if name not in known:
            raise KeyError(f"no pack {name!r}")
        if name not in done:
            for other in known[name].requires:
                visit(other, (*path, name))
            done.append(name)

    for name in names:
        visit(name, ())
    return done


@dataclass
class Knowledge:
    packs: list[str]
    entities: dict[str, dict]
    themes: list[Theme]
    min_hits: int
    strip: list[str]
    stop: set[str]
    markings: list[str]
    origins: list[OriginRule]
    classifications: list[ClassificationRule]
    date_hints: list[tuple[int, Callable]]
    published: list[Callable]
    metadata: list[Callable]
    presets: list[dict]

    def entity_table(self, spark: SparkSession) -> DataFrame:
        """``key, name, type, aliases, description, pack_ord, ord``."""
        rows = [(e["key"], e["name"], e["type"], e["aliases"], e["description"], self.packs.index(e["pack"]), k) for k, e in enumerate(self.entities.values())]
        return spark.createDataFrame(rows, "key string, name string, type string, aliases array<string>, description string, pack_ord int, ord int")

    def conflicts(self, spark: SparkSession) -> DataFrame:
        """Aliases that two entities claim; the first owner wins when matching."""
        rows = self.entity_table(spark).select("key", "pack_ord", "ord", F.explode("aliases").alias("alias"))
        one = (F.size(F.split("alias", " ")) == 1) | (F.col("alias") == F.upper("alias")) | F.col("alias").rlike("[0-9]")
        keyed = rows.withColumn("identity", F.when(one, F.col("alias")).otherwise(F.lower("alias")))
        owner = keyed.groupBy("identity").agg(F.min_by("key", F.struct("pack_ord", "ord")).alias("owner"))
        return keyed.join(owner, "identity").filter(F.col("key") != F.col("owner")).select("alias", "owner", F.col("key").alias("claimed_by"))


def _unique(items: list, key: Callable = lambda x: x) -> list:
    seen: dict = {}
    for x in items:
        seen.setdefault(key(x), x)
    return list(seen.values())


def merge(names: list[str], known: dict[str, Pack], suppress: tuple[str, ...] = (), keep: tuple[str, ...] = (), origin_rules: tuple[OriginRule, ...] = ()) -> Knowledge:
    """Packs in order of requirement.

    A later pack extends an entity of the same type and name, but takes no alias
    that another owns; its description, if any, replaces.  Rules are unique and
    sorted by priority, in order among equals.  A pack's suppressed aliases count
    only if nothing but it and its requirements is loaded; ``keep`` saves aliases,
    ``suppress`` adds some.  An entity without aliases goes."""
    names = order(names, known)
    packs = [known[n] for n in names]
    entities: dict[str, dict] = {}
    owner: dict[str, str] = {}
    dropped: set[str] = set(map(alias_identity, suppress))
    for pack in packs:
        for kind, name, aliases, description in pack.entities:
            key = f"{kind}:{name}"
            if key in entities:
                own = entities[key]
                own["aliases"] = sorted({*own["aliases"], *(a for a in aliases if owner.get(alias_identity(a), key) == key)})
                own["description"] = description or own["description"]
            else:
                entities[key] = own = {"key": key, "name": name, "type": kind, "aliases": sorted({name, *aliases}), "description": description, "pack": pack.name}
            for a in own["aliases"]:
                owner.setdefault(alias_identity(a), key)
        for key, text in pack.descriptions.items():
            if key in entities:
                entities[key]["description"] = text
        if set(names) <= set(order([pack.name], known)):
            dropped |= set(map(alias_identity, pack.suppress))
    dropped -= set(map(alias_identity, keep))
    for e in entities.values():
        e["aliases"] = [a for a in e["aliases"] if alias_identity(a) not in dropped]
    every = lambda name: [x for p in packs for x in getattr(p, name)]
    by_priority = lambda rules: sorted(_unique(rules), key=lambda r: r.priority)
    hits = [p.min_hits for p in packs if p.min_hits is not None]
    return Knowledge(
        names, {k: e for k, e in entities.items() if e["aliases"]}, _unique(every("themes"), lambda t: t.name), hits[-1] if hits else MIN_HITS, _unique(every("strip")), set(every("stop")), _unique(every("markings")),
        by_priority(every("origins") + list(origin_rules)), by_priority(every("classifications")), sorted(every("date_hints"), key=lambda x: x[0]), every("published"), every("metadata"), _unique(every("presets"), lambda p: p["title"]),
    )
