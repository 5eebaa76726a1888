"""Dictionary matching: aliases found by greedy leftmost-longest search over tokens."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.text import is_all_caps, tokens

#: Types whose single-word aliases may match in capitals though they are ordinary words.
CAPS_TYPES = frozenset("place agency organization program technology idea".split())
#: First tokens of aliases up to which pages without any are left out natively.
FIRST_TOKENS = 2_000


def case_sensitive(alias: str) -> bool:
    """One word, all capitals or a digit: matched as written."""
    return len(alias.split()) == 1 or alias.isupper() or any(map(str.isdigit, alias))


class Trie:
    """Aliases by token, in three dictionaries: as written, without case, in capitals.

    Each node maps a token to its child; the key of an alias stands under None.
    The first owner of an alias keeps it."""

    def __init__(self, words: frozenset[str] = frozenset()):
        self.exact: dict = {}
        self.folded: dict = {}
        self.capital: dict = {}
        self.words = frozenset(w.lower() for w in words)

    @staticmethod
    def _put(root: dict, path: list[str], key: str) -> None:
        for token in path:
            root = root.setdefault(token, {})
        root.setdefault(None, key)

    def add(self, alias: str, path: list[str], key: str, kind: str | None = None) -> None:
        """alias as written, and its tokens."""
        if not path:
            return
        if case_sensitive(alias):
            self._put(self.exact, path, key)
            if len(path) == 1 and alias.islower():
                self._put(self.exact, [path[0][0].upper() + path[0][1:]], key)
        else:
            self._put(self.folded, [t.lower() for t in path], key)
        if not alias.isupper():
            ordinary = len(path) == 1 and path[0].lower() in self.words
            if not ordinary or (kind in CAPS_TYPES and not alias.islower()):
                self._put(self.capital, [t.upper() for t in path], key)

    @staticmethod
    def _ends(root: dict, path: list[str], start: int) -> dict[int, str]:
        """Length and key of every alias that starts here."""
        found, k = {}, start
        while k < len(path) and path[k] in root:
            root = root[path[k]]
            k += 1
            if None in root:
                found[k - start] = root[None]
        return found

    def find(self, path: list[str], all_caps: bool = False) -> Iterator[str]:
        lower = [t.lower() for t in path]
        at = 0
        while at < len(path):
            exact = self._ends(self.exact, path, at)
            if all_caps and path[at].isupper() and lower[at] in self.words:
                exact.pop(1, None)  # in a page of capitals a dictionary word is just a word
            sources = [self._ends(self.capital, path, at) if all_caps else {}, self._ends(self.folded, lower, at), exact]
            best = max((n for s in sources for n in s), default=0)
            if not best:
                at += 1
                continue
            yield next(s[best] for s in reversed(sources) if best in s)
            at += best


_TRIES: dict[str, Trie] = {}


def _trie(name: str, held) -> Trie:
    """The trie of a broadcast dictionary, built once in a worker, the last one kept."""
    if name not in _TRIES:
        words, rows = held.value
        trie = Trie(words)
        for row in rows:
            trie.add(*row)
        _TRIES.clear()
        _TRIES[name] = trie
    return _TRIES[name]


def alias_table(entities: DataFrame) -> DataFrame:
    """``alias, key, type``, one owner per alias: the first by pack order, then by
    position.  entities: key, type, aliases, pack_ord, ord."""
    rows = entities.select("key", "type", "pack_ord", "ord", F.posexplode("aliases").alias("place", "alias"))
    one = (F.size(F.split("alias", " ")) == 1) | (F.col("alias") == F.upper("alias")) | F.col("alias").rlike("[0-9]")
    rows = rows.withColumn("identity", F.when(one, F.col("alias")).otherwise(F.lower("alias")))
    rank = F.row_number().over(Window.partitionBy("identity").orderBy("pack_ord", "ord", "place"))
    return rows.withColumn("rank", rank).filter("rank = 1").select("alias", "key", "type", "pack_ord", "ord")


def match_pages(pages: DataFrame, aliases: DataFrame, words: frozenset[str] = frozenset(), max_aliases: int = 2_000_000, caps_matching: bool = True) -> DataFrame:
    """``doc_id, page_no, key, count`` of gazetteer hits.

    The alias dictionary is collected, its size checked, and broadcast; a worker
    builds its trie once.  Tokens are cut natively; the greedy search runs over Arrow
    batches, and only on pages that have the first token of some alias."""
    rows = aliases.withColumn("path", tokens(F.col("alias"))).orderBy("pack_ord", "ord", "alias").limit(max_aliases + 1).collect()
    if len(rows) > max_aliases:
        raise ValueError(f"more than {max_aliases} aliases: split the dictionary")
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast((words, [tuple(r[c] for c in ("alias", "path", "key", "type")) for r in rows]))
    name = uuid.uuid4().hex
    caps = is_all_caps(F.col("text")) if caps_matching else F.lit(False)
    cut = pages.select("doc_id", "page_no", caps.alias("caps"), tokens(F.col("text")).alias("path"))
    starts = sorted({r["path"][0].lower() for r in rows if r["path"]})
    if len(starts) <= FIRST_TOKENS:  # few enough for a literal of the plan
        cut = cut.filter(F.arrays_overlap(F.transform("path", F.lower), F.lit(starts).cast("array<string>")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = _trie(name, held)
        for batch in batches:
            found = [(d, p, k, n) for d, p, c, path in batch.itertuples(index=False) for k, n in Counter(trie.find(list(path), bool(c))).items()]
            yield pd.DataFrame(found, columns=["doc_id", "page_no", "key", "count"])

    return cut.mapInPandas(run, f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, page_no int, key string, count int")
