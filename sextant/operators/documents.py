"""Operators over documents, their mentions and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NO_VALUE = "—"


def dedupe(docs: DataFrame, prefer: tuple[str, ...] = (), hash_col: str = "sha1") -> DataFrame:
    """One row per content hash: the keeper, and the paths of the others.

    Kept is the copy outside archives, then under a preferred prefix, then with
    the shortest path, then first by path.  docs: relpath and the hash."""
    preferred = F.lit(False)
    for p in prefer:
        preferred = preferred | F.col("relpath").startswith(p)
    rank = F.struct(F.col("relpath").contains("!/").alias("a"), (~preferred).alias("b"), F.length("relpath").alias("c"), F.col("relpath").alias("d"))
    grouped = docs.groupBy(hash_col).agg(F.min(rank).alias("best"), F.array_sort(F.collect_set("relpath")).alias("all"))
    return grouped.select(hash_col, F.col("best.d").alias("relpath"), F.array_remove("all", F.col("best.d")).alias("duplicates"))


def filter_documents(docs: DataFrame, facets: dict[str, str] | None = None, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Facet equality, and a year range that leaves out undated documents."""
    for name, value in (facets or {}).items():
        docs = docs.filter(F.col(name) == value)
    if year_from is not None:
        docs = docs.filter(F.col("year") >= year_from)
    if year_to is not None:
        docs = docs.filter(F.col("year") <= year_to)
    return docs


def facets(docs: DataFrame, names: tuple[str, ...] = ("collection", "origin", "classification", "kind"), year: str | None = "year") -> DataFrame:
    """``facet, value, n`` for every value of every facet, in one aggregation over
    grouping sets; empty values show as a dash, undated documents have no year."""
    shown = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(NO_VALUE)).alias(c) for c in names]
    columns = [*names, *([year] if year else [])]
    rows = docs.select(*shown, *([F.col(year).cast("string").alias(year)] if year else []))
    sets = [[F.col(c)] for c in columns]
    grouped = rows.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in columns])
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        facet = F.when(F.col(f"g_{c}") == 0, F.lit(c)).otherwise(facet)
        value = F.when(F.col(f"g_{c}") == 0, F.col(c)).otherwise(value)
    return grouped.select(facet.alias("facet"), value.alias("value"), "n").filter(F.col("value").isNotNull())


def counts_by(docs: DataFrame, column: str, limit: int | None = None, pages: str | None = None) -> DataFrame:
    """Documents (and pages) per value, most first, then value."""
    aggs = [F.count(F.lit(1)).alias("n"), *([F.sum(pages).alias("pages")] if pages else [])]
    out = docs.groupBy(F.col(column).alias("value")).agg(*aggs)
    return out.orderBy(F.desc("n"), "value").limit(limit) if limit else out


def library_card(docs: DataFrame, lo: int, hi: int) -> DataFrame:
    """Documents, pages and the year span within bounds, one row."""
    inside = F.when(F.col("year").between(lo, hi), F.col("year"))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.min(inside).alias("first_year"), F.max(inside).alias("last_year"))


def related_documents(mentions: DataFrame, ids: DataFrame, doc_id: str, limit: int = 12, max_entity_docs: int | None = None) -> DataFrame:
    """Documents that share entities with one: the weight adds 1 / documents of the
    entity for every mention row of the other document; shared counts entities."""
    own = mentions.filter(F.col("doc_id") == doc_id).select("entity_id").distinct()
    weights = ids.select(F.col("id").alias("entity_id"), "doc_count")
    if max_entity_docs is not None:
        weights = weights.filter(F.col("doc_count") < max_entity_docs)
    rows = mentions.filter(F.col("doc_id") != doc_id).join(own, "entity_id", "left_semi").join(weights, "entity_id")
    out = rows.groupBy("doc_id").agg(F.round(F.sum(1.0 / F.col("doc_count")), 9).alias("weight"), F.countDistinct("entity_id").alias("shared"))
    return out.orderBy(F.desc("weight"), "doc_id").limit(limit)


def docs_with_all(mentions: DataFrame, entity_ids: list[int]) -> DataFrame:
    """Documents that mention every one of the entities: left-semi joins."""
    out = mentions.select("doc_id").distinct()
    for e in entity_ids:
        out = out.join(mentions.filter(F.col("entity_id") == e).select("doc_id").distinct(), "doc_id", "left_semi")
    return out


def top_documents(mentions: DataFrame, docs: DataFrame, entity_id: int, limit: int = 400) -> DataFrame:
    """The documents with most mentions of an entity, with its pages: the top is
    taken before the documents are joined."""
    top = mentions.filter(F.col("entity_id") == entity_id).groupBy("doc_id").agg(F.sum("count").alias("mentions"), F.array_sort(F.collect_set("page_no")).alias("pages"))
    top = top.orderBy(F.desc("mentions"), "doc_id").limit(limit)
    return top.join(docs.select(F.col("id").alias("doc_id"), "title", "doc_date"), "doc_id")


def entity_list(entities: DataFrame, kind: str | None = None, text: str | None = None, hide_auto: bool = False, limit: int = 1000) -> DataFrame:
    """Entities by type and by part of a name or alias, without regard to case."""
    out = entities
    if kind:
        out = out.filter(F.col("type") == kind)
    if hide_auto:
        out = out.filter(F.col("auto") == 0)
    if text:
        found = F.lower(F.lit(text))
        out = out.filter(F.contains(F.lower("name"), found) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), found)))
    return out.orderBy(F.desc("doc_count"), "id").limit(limit)


def autocomplete(entities: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Exact names first, then prefixes, then most documents."""
    name, low = F.lower("name"), text.lower()
    found = entities.filter(F.contains(name, F.lit(low)))
    return found.orderBy(F.desc(name == low), F.desc(F.startswith(name, F.lit(low))), F.desc("doc_count"), "id").limit(limit)


def document_entities(mentions: DataFrame, entities: DataFrame, doc_id: str) -> DataFrame:
    own = mentions.filter(F.col("doc_id") == doc_id).groupBy("entity_id").agg(F.sum("count").alias("count"), F.array_sort(F.collect_set("page_no")).alias("pages"))
    return own.join(entities.select(F.col("id").alias("entity_id"), "name", "type"), "entity_id").orderBy("type", F.desc("count"), "name")


def document_relations(evidence: DataFrame, entities: DataFrame, doc_id: str, limit: int = 200) -> DataFrame:
    a, b = (entities.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("src", "dst"))
    return evidence.filter(F.col("doc_id") == doc_id).join(a, "src").join(b, "dst").orderBy("type", "src_name", "dst_name").limit(limit)


def context_chips(mentions: DataFrame, entities: DataFrame, results: DataFrame, types: tuple[str, ...], per_doc: int = 8) -> DataFrame:
    """Each result's entities of some types with most mentions."""
    own = mentions.join(results.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", "entity_id").agg(F.sum("count").alias("n"))
    typed = own.join(entities.filter(F.col("type").isin(*types)).select(F.col("id").alias("entity_id"), "name", "type"), "entity_id")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "entity_id"))
    return typed.withColumn("rank", rank).filter(F.col("rank") <= per_doc)


def date_order(direction: str) -> list[Column]:
    """Sort by date string: undated last, in either direction."""
    if direction == "date_asc":
        return [F.coalesce(F.nullif("doc_date", F.lit("")), F.lit("9999")).asc(), F.col("id").asc()]
    return [F.coalesce(F.nullif("doc_date", F.lit("")), F.lit("0000")).desc(), F.col("id").asc()]


def page_of(rows: DataFrame, page: int, size: int = 25) -> DataFrame:
    """Page 1, 2, ... of ordered rows."""
    return rows.offset(max(0, page - 1) * size).limit(size)


def collection_overlap(members: DataFrame, group: str = "collection", key: str = "key") -> DataFrame:
    """Jaccard of every two groups' keys: ``a, b, shared, jaccard``."""
    own = members.select(F.col(group).alias("g"), F.col(key).alias("k")).distinct()
    sizes = own.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    shared = own.groupBy("k").agg(F.array_sort(F.collect_set("g")).alias("gs")).filter(F.size("gs") > 1)
    pair = F.flatten(F.transform("gs", lambda a, i: F.transform(F.slice("gs", i + 2, F.size("gs")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    counts = shared.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"))
    na, nb = (sizes.select(F.col("g").alias(c), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    return counts.join(na, "a").join(nb, "b").select("a", "b", "shared", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), 4).alias("jaccard"))
