"""The engine's views, as functions that return DataFrames over built corpora."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.fold import gkey
from sextant.operators import documents as D
from sextant.operators import globalindex as G
from sextant.operators import graph as GR
from sextant.operators import search as S
from sextant.operators import timeline as T
from sextant.plans.catalog import Catalog
from sextant.scratch import cut, drop

#: Seconds after which a build that failed is tried again.
BACKOFF = 300
CHIP_TYPES = ("person", "agency", "company", "place", "program")


class Corpus:
    """Views of one built corpus."""

    def __init__(self, catalog: Catalog, corpus: str, lo: int = 1000, hi: int = 9999):
        self.catalog, self.id, self.lo, self.hi = catalog, corpus, lo, hi
        self._index: S.Index | None = None

    def table(self, name: str) -> DataFrame:
        return self.catalog.read(self.id, name)

    def has_table(self, name: str) -> bool:
        p, fs = self.catalog._fs(f"{self.catalog.root}/{self.id}/{self.catalog.version(self.id)}/{name}")
        return fs.exists(p)

    @property
    def index(self) -> S.Index:
        """Full-text index, built on first use and kept for the session."""
        if self._index is None:
            self._index = S.Index.build(self.table("pages"), self.table("documents"))
        return self._index

    def overview(self) -> dict[str, DataFrame]:
        docs = self.table("documents")
        return {
            "by_year": D.counts_by(docs.filter("year is not null"), "year"), "by_collection": D.counts_by(docs, "collection", 40, "pages"), "by_origin": D.counts_by(docs, "origin", 25), "by_kind": D.counts_by(docs, "kind", 25),
            "entity_types": self.entity_types(), "relation_types": self.table("relations").groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(14),
        }

    def search(self, query: str, order: str = "relevance", page: int = 1, **filters) -> dict[str, object]:
        """One page of results with chips, facets over all of them, and suggestions."""
        mentions = self.table("mentions")
        hits, error = S.safe_search(self.index, query, mentions=mentions, **filters)
        hits = hits.cache()
        renamed = hits.withColumnRenamed("doc_id", "id")
        ordered = renamed.orderBy(*(D.date_order(order) if order.startswith("date") else [F.asc("score"), F.asc("id")]))
        shown = D.page_of(ordered, page)
        names = tuple(c for c in ("collection", "origin", "classification", "kind") if c in hits.columns)
        return {
            "results": shown, "total": hits.count(), "facets": D.facets(hits, names), "chips": D.context_chips(mentions, self.table("entities"), shown.select(F.col("id").alias("doc_id")), CHIP_TYPES),
            "entities": self.entities(text=query, limit=8) if query.strip() not in ("", "*") else None, "error": error,
        }

    def document(self, doc_id: str) -> dict[str, DataFrame]:
        mentions, entities = self.table("mentions"), self.table("entities")
        docs = self.table("documents")
        related = D.related_documents(mentions, entities, doc_id).join(docs.select(F.col("id").alias("doc_id"), "title", "doc_date"), "doc_id")
        return {
            "document": docs.filter(F.col("id") == doc_id).withColumn("has_original", ~F.col("kind").isin("record", "chat")), "pages": self.table("pages").filter(F.col("doc_id") == doc_id).orderBy("page_no"),
            "entities": D.document_entities(mentions, entities, doc_id), "relations": D.document_relations(self.table("relation_docs"), entities, doc_id), "related": related,
        }

    def entity(self, entity_id: int) -> dict[str, DataFrame]:
        entities, edges, mentions, docs = (self.table(t) for t in ("entities", "edges", "mentions", "documents"))
        near = GR.neighbours(edges, entity_id, entities).orderBy(F.desc("docs"), "other").limit(400)
        own = self.table("relations").filter((F.col("src") == entity_id) | (F.col("dst") == entity_id))
        return {
            "entity": entities.filter(F.col("id") == entity_id), "top": GR.top_neighbours(near), "distinctive": GR.distinctive_neighbours(near), "relations": own.orderBy(F.desc("docs"), "src", "dst", "type").limit(300),
            "documents": D.top_documents(mentions, docs, entity_id), "timeline": self.timeline([entity_id]),
        }

    def entity_types(self) -> DataFrame:
        return self.table("entities").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("auto").alias("auto"))

    def entities(self, kind: str | None = None, text: str | None = None, hide_auto: bool = False, limit: int = 1000) -> DataFrame:
        return D.entity_list(self.table("entities"), kind, text, hide_auto, limit)

    def autocomplete(self, text: str, limit: int = 20) -> DataFrame:
        return D.autocomplete(self.table("entities"), text, limit)

    def graph(self, types: list[str] | None = None, limit: int = 150, min_docs: int = 2, max_docs: int | None = None, k: int = 6, focus: int | None = None, metric: str = "docs", source: str = "edges", hide_auto: bool = False) -> dict[str, DataFrame]:
        """Nodes and links; source: edges (co-occurrence) or relations."""
        nodes = GR.node_filter(self.table("entities"), types, max_docs=max_docs, hide_auto=hide_auto)
        if source == "relations":
            links = GR.relation_graph(self.table("relations"), nodes, limit, k)
        elif focus is not None:
            links = GR.strongest_links(GR.ego_network(self.table("edges"), focus, limit, metric, min_docs), k, metric)
        else:
            links = GR.top_subgraph(nodes, self.table("edges"), limit, min_docs, k)
        return {"links": links, "nodes": GR.connected(self.table("entities"), links)}

    def timeline(self, entity_ids: list[int], share: bool = False, min_year_docs: int = 0) -> DataFrame:
        return T.series(self.table("mentions"), self.table("documents"), entity_ids, self.lo, self.hi, share, min_year_docs)

    def docs_with_all(self, entity_ids: list[int]) -> DataFrame:
        return D.docs_with_all(self.table("mentions"), entity_ids)


class Library:
    """Views over all corpora, and the global index."""

    def __init__(self, catalog: Catalog, lo: int = 1000, hi: int = 9999):
        self.catalog, self.lo, self.hi = catalog, lo, hi
        self._failed = -math.inf

    def corpora(self) -> list[str]:
        return [c for c in self.catalog.corpora() if not c.startswith("_")]

    def all(self, table: str, corpora: list[str] | None = None) -> DataFrame:
        parts = [self.catalog.read(c, table).withColumn("corpus_id", F.lit(c)) for c in (self.corpora() if corpora is None else corpora)]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def library(self) -> DataFrame:
        """A card per corpus: documents, pages, year span."""
        inside = F.when(F.col("year").between(self.lo, self.hi), F.col("year"))
        return self.all("documents").groupBy("corpus_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.min(inside).alias("first_year"), F.max(inside).alias("last_year"))

    def search_all(self, query: str, per_corpus: int = 5) -> DataFrame:
        """The first results of every corpus with its total, most first."""
        parts = [S.search(Corpus(self.catalog, c).index, query).select(F.lit(c).alias("corpus_id"), "doc_id", "score", "title") for c in self.corpora()]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return S.search_all(out, per_corpus).orderBy(F.desc("total"), "corpus_id", "rank")

    # -------------------------------------------------------------- global index
    def current(self, required: bool = True) -> str | None:
        """The version of the global index that views read: the last good one, also while
        it is stale.  Where none was built yet, a view that requires one waits for it and
        any other gets None.  A build that failed is not tried again for BACKOFF seconds."""
        version = self.catalog.version("_global")
        if version is not None or not required:
            return version
        if time.monotonic() - self._failed < BACKOFF:
            raise RuntimeError(f"the global index could not be built; next attempt after {BACKOFF} seconds")
        try:
            return self.build_global()
        except Exception:
            self._failed = time.monotonic()
            raise

    def build_global(self, full: bool = False) -> str:
        """Merge all corpora; does nothing if no corpus changed.  The last good
        version stays current until the new one is whole.

        With a last version, only corpora of another version than it knows (new, rebuilt
        or removed) are read: their rows are taken out of it and put in anew, and what
        they touch is merged again."""
        stamp = self.catalog.stamp()
        if not self.catalog.stale(stamp) and not full:
            return self.catalog.version("_global")
        now = dict(x.split("=", 1) for x in stamp.split("|") if x)
        before: dict[str, str] = {}
        if not full and self.catalog.version("_global") is not None:
            before = dict(x.split("=", 1) for x in self.table("meta").filter("k = 'stamp'").first()["v"].split("|") if x)
        changed = sorted(c for c, v in now.items() if before.get(c) != v)
        gone = sorted(c for c, v in before.items() if now.get(c) != v)
        meta = self.catalog.spark.createDataFrame([("stamp", stamp), ("read", "|".join(changed))], "k string, v string")
        if not before:
            t = self._parts(changed)
            merged = cut(G.merge(t["local"], t["variants"]))
            return self.catalog.write("_global", t | {"entities": merged, "links": G.sum_links(t["corpus_links"]), "type_counts": G.type_counts(merged), "meta": meta})
        old = {name: self.table(name) for name in ("local", "variants", "corpora", "years", "corpus_links", "entities", "links")}
        new = self._parts(changed) if changed else {name: old[name].limit(0) for name in ("local", "variants", "corpora", "years", "corpus_links")}
        t = {name: G.replaced(old[name], df, gone) for name, df in new.items()}
        merged = cut(G.merged_again(old["entities"], old["local"], t["local"], t["variants"], new["local"], gone))
        return self.catalog.write("_global", t | {"entities": merged, "links": G.links_again(old["links"], old["corpus_links"], new["corpus_links"], gone), "type_counts": G.type_counts(merged), "meta": meta})

    def _parts(self, corpora: list[str]) -> dict[str, DataFrame]:
        """What some corpora give to the global index, each row with its corpus in cid.
        Each table is written once; those that follow from it read its files.  Mentions
        are read for entities alone of which one corpus has several spellings."""
        local = cut(G.local_entities(self.all("entities", corpora).withColumn("gkey", gkey(F.col("type"), F.col("name")))))
        keys = self.all("entities", corpora).select("corpus_id", F.col("id").alias("entity_id"), "key")
        several = cut(keys.join(G.spellings(local).select(F.col("cid").alias("corpus_id"), "key"), ["corpus_id", "key"], "left_semi"))
        mentions = self.all("mentions", corpora).join(several, ["corpus_id", "entity_id"]).select("corpus_id", "key", "doc_id")
        docs = self.all("documents", corpora)
        bounds = cut(G.corpus_bounds(docs, self.lo, self.hi))
        a = keys.select("corpus_id", F.col("entity_id").alias("src"), F.col("key").alias("src_key"))
        b = keys.select("corpus_id", F.col("entity_id").alias("dst"), F.col("key").alias("dst_key"))
        edges = self.all("edges", corpora).join(a, ["corpus_id", "src"]).join(b, ["corpus_id", "dst"])
        made = {"local": local, "variants": cut(G.distinct_docs(local, mentions)), "corpora": bounds, "years": cut(G.years(docs, bounds)), "corpus_links": cut(G.corpus_links(edges, local))}
        drop(several)
        return made

    def table(self, name: str) -> DataFrame:
        return self.catalog.read("_global", name)

    def entities(self, kind: str | None = None, text: str | None = None, hide_auto: bool = False, limit: int = 1000) -> DataFrame:
        return D.entity_list(self.table("entities").withColumnRenamed("gkey", "id"), kind, text, hide_auto, limit)

    def entity(self, key: str) -> dict[str, DataFrame]:
        near = G.neighbours(self.table("links"), key)
        n = self.table("corpora").agg(F.greatest(F.sum("docs"), F.lit(1)).alias("n"))
        return {"entity": self.table("entities").filter(F.col("gkey") == key), "presence": G.presence(self.table("local"), self.table("variants"), key), "neighbours": near.join(self.table("entities").select("gkey", "name", "type", "doc_count"), "gkey"), "documents_in_all": n}

    def also_in(self, corpus: str, key: str) -> DataFrame:
        """Other corpora that have an entity of one corpus."""
        local = self.table("local")
        own = local.filter((F.col("cid") == corpus) & (F.col("key") == key)).select("gkey")
        return local.join(own, "gkey", "left_semi").filter(F.col("cid") != corpus)

    def pair(self, a: str, b: str) -> DataFrame:
        keys = self.all("entities").select("corpus_id", F.col("id").alias("entity_id"), "key")
        mentions = self.all("mentions").join(keys, ["corpus_id", "entity_id"])
        return G.pair_documents(mentions, self.table("local"), a, b)

    def graph(self, limit: int = 150, min_docs: int = 2, k: int = 6, focus: str | None = None, types: list[str] | None = None) -> dict[str, DataFrame]:
        links = self.table("links").select(F.col("a").alias("src"), F.col("b").alias("dst"), "docs")
        nodes = self.table("entities").withColumnRenamed("gkey", "id")
        if types:
            nodes = nodes.filter(F.col("type").isin(*types))
        if focus is not None:
            near = GR.neighbours(links.filter(F.col("docs") >= min_docs), focus).orderBy(F.desc("docs"), "other").limit(limit).select(F.col("other").alias("id"))
            chosen = near.unionAll(self.catalog.spark.range(1).select(F.lit(focus).alias("id")))
        else:
            chosen = nodes.orderBy(F.desc("doc_count"), "id").limit(limit).select("id")
        found = GR.strongest_links(GR.induced(links, chosen, min_docs), k)
        return {"links": found, "nodes": GR.connected(nodes, found)}

    def timeline(self, keys: list[str], share: bool = False) -> DataFrame:
        """Documents per year of global entities, each corpus within its own bounds."""
        local = self.table("local").filter(F.col("gkey").isin(*keys)).select(F.col("cid").alias("corpus_id"), "key", "gkey")
        ids = self.all("entities").select("corpus_id", F.col("id").alias("entity_id"), "key").join(local, ["corpus_id", "key"])
        docs = self.all("documents").select("corpus_id", F.col("id").alias("doc_id"), "year").join(self.table("corpora").select(F.col("cid").alias("corpus_id"), "lo", "hi"), "corpus_id").filter(F.col("year").between(F.col("lo"), F.col("hi")))
        found = self.all("mentions").join(ids, ["corpus_id", "entity_id"]).select("gkey", "corpus_id", "doc_id").distinct().join(docs, ["corpus_id", "doc_id"])
        counts = found.groupBy("gkey", "year").agg(F.count(F.lit(1)).alias("n"))
        totals = G.total_years(self.table("years")).withColumnRenamed("n", "total").withColumn("gkey", F.explode(F.array(*[F.lit(k) for k in keys])))
        n = F.coalesce("n", F.lit(0))
        return totals.join(counts, ["gkey", "year"], "left").select("gkey", "year", (F.round(100.0 * n / F.col("total"), 2) if share else n.cast("double")).alias("value"))

    def across(self, limit: int = 50) -> DataFrame:
        """Entities in most corpora."""
        return self.table("entities").filter("n_corpora > 1").orderBy(F.desc("n_corpora"), F.desc("doc_count"), "gkey").limit(limit)

    def overlap(self) -> DataFrame:
        return D.collection_overlap(self.table("local").filter("auto = 0").select(F.col("cid").alias("collection"), F.col("gkey").alias("key")))

    def by_year_and_corpus(self, key: str) -> DataFrame:
        local = self.table("local").filter(F.col("gkey") == key).select(F.col("cid").alias("corpus_id"), "key")
        ids = self.all("entities").select("corpus_id", F.col("id").alias("entity_id"), "key").join(local, ["corpus_id", "key"])
        found = self.all("mentions").join(ids, ["corpus_id", "entity_id"]).select("corpus_id", "doc_id").distinct().join(self.all("documents").select("corpus_id", F.col("id").alias("doc_id"), "year"), ["corpus_id", "doc_id"])
        return found.groupBy("year").pivot("corpus_id", self.corpora()).count().fillna(0).orderBy("year")

    def top_documents(self, key: str, limit: int = 400) -> DataFrame:
        local = self.table("local").filter(F.col("gkey") == key).select(F.col("cid").alias("corpus_id"), "key")
        ids = self.all("entities").select("corpus_id", F.col("id").alias("entity_id"), "key").join(local, ["corpus_id", "key"])
        per = self.all("mentions").join(ids, ["corpus_id", "entity_id"]).groupBy("corpus_id", "doc_id").agg(F.sum("count").alias("mentions"))
        return G.merged_top(per, limit)

    def best_in_corpus(self) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("doc_count"), "key"))
        return self.table("local").withColumn("rank", rank).filter("rank <= 12")
