"""A corpus from files to tables: discover, extract, index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.config import CorpusConfig
from sextant.functions import text as TX
from sextant.functions.names import org_udf, person_udf
from sextant.knowledge.pack import Knowledge
from sextant.operators import codenames as CN
from sextant.operators import edges as E
from sextant.operators import matcher, metadata, themes
from sextant.operators import mentions as M
from sextant.operators import relations as R
from sextant.operators.documents import dedupe
from sextant.schema import GAZETTEER, NER_KNOWN, NER_NEW, PATTERN, STRUCTURED
from sextant.scratch import cut
from sextant.sources import archives, discover, formats

#: Pending files whose paths go to the reader.
LISTED = 100_000


def extract(spark: SparkSession, config: CorpusConfig, manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Extracted documents of a corpus folder, and the listing they come from.

    With a manifest only changed sources are read.  Archives and mailboxes are
    expanded; each message and member is a document of its own."""
    settings = config["extract"]
    listing = discover.discover(discover.list_files(spark, config.root, settings["include"]), settings["include"], settings["exclude"], settings["max_file_mb"], settings["archives"])
    wanted = listing.filter(F.col("reason").isNull()).withColumn("stat", F.concat_ws(":", "size", F.col("mtime").cast("string")))
    if manifest is not None:
        wanted = discover.pending(wanted, manifest)
    loaded = _with_contents(wanted.select("path", "relpath", "kind"), config.root)
    loaded = loaded.withColumn("kind", F.when((F.col("kind") == "text") & TX.basename(F.col("relpath")).rlike(r"^[^.]+$") & discover.looks_like_html(F.col("content")), "html").otherwise(F.col("kind")))
    none = F.lit(None).cast("string")
    whole = [none.alias("member"), none.alias("error")]
    plain = loaded.filter(~F.col("kind").isin("zip", "tar", "7z", "rar", "mbox")).select("relpath", "kind", "content", *whole)
    boxes = archives.expand_mbox(loaded.filter("kind = 'mbox'")).select("relpath", F.lit("eml").alias("kind"), "content", *whole)
    members = archives.expand(loaded.filter(F.col("kind").isin("zip", "tar", "7z", "rar")), tuple(settings["archive_members"]), settings["max_file_mb"])
    kind = F.when(F.col("error").isNotNull(), "archive").otherwise(discover.format_of(F.col("member")))  # one that cannot be read is a document with an error
    members = members.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("relpath", "kind", "content", "member", "error")
    found = formats.extract(plain.unionByName(boxes).unionByName(members))
    return found.withColumn("collection", none).withColumn("classification", none), listing


def _with_contents(wanted: DataFrame, root: str) -> DataFrame:
    """The listed files with their contents.  Up to LISTED paths the reader gets the
    paths, so that nothing else is read; more are joined to all files below the root."""
    spark = wanted.sparkSession
    paths = [r[0] for r in wanted.select("path").limit(LISTED + 1).collect()]
    if not paths:
        return wanted.withColumn("content", F.lit(None).cast("binary"))
    reader = spark.read.format("binaryFile")
    files = reader.load(paths) if len(paths) <= LISTED else reader.option("recursiveFileLookup", "true").load(root)
    return wanted.join(files.select("path", "content"), "path")


def with_ocr(extracted: DataFrame, recognised: DataFrame) -> DataFrame:
    """Extracted documents with recognised text merged into the pages that await it,
    and ``complete``: no page still waits.  recognised: relpath, page_no, ocr_text."""
    jobs = F.coalesce("ocr_jobs", F.array().cast("array<int>"))
    pages = extracted.select(F.col("relpath").alias("doc_id"), jobs.alias("jobs"), F.explode("pages").alias("p"))
    pages = pages.select("doc_id", F.col("p.n").alias("page_no"), F.col("p.text").alias("text"), F.array_contains("jobs", F.col("p.n")).alias("job"))
    merged = formats.apply_ocr(pages, recognised.select(F.col("relpath").alias("doc_id"), "page_no", "ocr_text"))
    page = F.struct(F.col("page_no").alias("n"), "text", "ocr")
    whole = merged.groupBy(F.col("doc_id").alias("relpath")).agg(F.array_sort(F.collect_list(page)).alias("pages"), F.bool_and(~F.col("missing")).alias("complete"))
    return extracted.drop("pages").join(whole, "relpath")


def ner_mentions(spans: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions of recognised names: by the owner of an alias, of the span's own type
    first, else under a new key.  spans: doc_id, page_no, label, name."""
    clean = F.when(F.col("label") == "person", person_udf()(F.col("name"))).otherwise(org_udf()(F.col("name")))
    rows = spans.withColumn("clean", clean).filter(F.col("clean").isNotNull()).withColumn("folded", F.lower("clean"))
    owners = aliases.select(F.lower("alias").alias("folded"), "type", "key", "pack_ord", "ord")
    found = rows.select("label", "folded").distinct().join(owners, "folded").groupBy("label", "folded").agg(F.min_by("key", F.struct(F.col("type") != F.col("label"), "pack_ord", "ord", "key")).alias("owner"))
    joined = rows.join(found, ["label", "folded"], "left")
    key = F.coalesce("owner", F.concat("label", F.lit(":"), "clean"))
    return joined.groupBy(key.alias("key"), "doc_id", "page_no", F.when(F.col("owner").isNull(), NER_NEW).otherwise(NER_KNOWN).alias("src")).agg(F.count(F.lit(1)).cast("int").alias("count"))


def records_as_extracted(rows: DataFrame, kind: str) -> DataFrame:
    """Documents of ``records.row_documents`` in the shape of extracted ones."""
    ref = "struct<type:string,name:string,key:string,aliases:array<string>,description:string,source:string>"
    none = F.lit(None).cast("string")
    refs = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["name"].alias("name"), none.alias("key"), F.array().cast("array<string>").alias("aliases"), none.alias("description"), F.lit("metadata").alias("source")))
    page = F.array(F.struct(F.lit(1).alias("n"), F.col("text").alias("text"), F.lit(0).alias("ocr")))
    return rows.select(
        "relpath", F.lit(kind).alias("kind"), page.alias("pages"), "title", "author", "doc_date", "origin", "fields", refs.cast(f"array<{ref}>").alias("entities"),
        F.lit(None).cast(f"array<struct<src:{ref},type:string,dst:{ref}>>").alias("relations"), F.lit(None).cast("array<string>").alias("attachments"), F.lit(None).cast("array<int>").alias("ocr_jobs"), none.alias("error"), none.alias("member"),
        none.alias("collection"), "classification",
    )


def resolve_refs(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Keys of structured references (columns type, name, key, aliases): an explicit
    key, else the owner of an alias of the same type, else a new key from type and
    name.  Aliases learned anywhere apply everywhere; the smallest key owns one."""
    known = aliases.select(F.col("type").alias("k_type"), F.lower("alias").alias("k_alias"), F.col("key").alias("k_key")).groupBy("k_type", "k_alias").agg(F.min("k_key").alias("k_key"))
    mail = refs.filter((F.col("type") == "person") & (F.size("aliases") > 0)).select(F.explode("aliases").alias("address"), F.concat(F.lit("person:"), "name").alias("mail_key"))
    mail = mail.groupBy("address").agg(F.min("mail_key").alias("mail_key"))
    joined = refs.join(known, (F.col("type") == F.col("k_type")) & (F.lower("name") == F.col("k_alias")), "left").join(mail, F.col("name") == F.col("address"), "left")
    return joined.withColumn("key", F.coalesce(F.nullif("key", F.lit("")), "k_key", "mail_key", F.concat("type", F.lit(":"), "name"))).drop("k_type", "k_alias", "k_key", "address", "mail_key")


def index(extracted: DataFrame, knowledge: Knowledge, config: CorpusConfig, words: frozenset[str] = frozenset(), checkpoint=lambda df, name: cut(df), ner: Callable[[DataFrame], DataFrame] | None = None, given_names: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a corpus.  ``checkpoint(df, name)`` persists a stage: later
    stages read a stage several times, and its lineage must not grow into theirs.

    words: an English dictionary.  ner: a recogniser, from pages (doc_id, page_no,
    text) to spans (doc_id, page_no, label, name); given_names (column name) lets
    names stay that only scanned pages have."""
    spark, settings = extracted.sparkSession, config["index"]
    docs = checkpoint(metadata.document_metadata(extracted, knowledge, config.data), "documents")
    text_hash = F.sha1(F.array_join(F.col("page_list")["text"], "\n").cast("binary"))
    kept = dedupe(docs.select("relpath", text_hash.alias("sha1")))
    documents = checkpoint(docs.join(kept.select("relpath", "duplicates"), "relpath"), "kept")
    ids = documents.select("id", "relpath")
    pages = documents.select(F.col("id").alias("doc_id"), F.explode("page_list").alias("p")).select("doc_id", F.col("p.n").alias("page_no"), F.col("p.text").alias("text"), F.col("p.ocr").alias("ocr"))
    pages = checkpoint(pages.withColumn("page_uid", F.xxhash64("doc_id", "page_no")), "pages")
    cleaned = pages.withColumn("text", metadata.strip_boilerplate(F.col("text"), knowledge.strip))
    table = knowledge.entity_table(spark).withColumn("auto", F.lit(0))
    spans = checkpoint(ner(cleaned), "spans") if ner else None
    if settings["codenames"]:
        table = table.unionByName(_codenames(cleaned, table, knowledge, words, spans))
    table = checkpoint(table, "knowledge")
    aliases = matcher.alias_table(table)
    raw = matcher.match_pages(cleaned, aliases, words, caps_matching=settings["allcaps_matching"]).withColumn("src", F.lit(GAZETTEER))
    parts = [raw.select("key", "doc_id", "page_no", "count", "src")]
    if knowledge.themes:
        parts.append(themes.theme_mentions(cleaned, knowledge.themes, knowledge.min_hits).select("key", "doc_id", "page_no", "count", F.lit(GAZETTEER).alias("src")))
    if settings["identifiers"]:
        found = F.concat(TX.emails(F.col("text")), TX.phones(F.col("text")), TX.ibans(F.col("text")))
        parts.append(pages.select(F.explode(found).alias("x"), "doc_id", "page_no").select(F.concat(F.lit("identifier:"), "x").alias("key"), "doc_id", "page_no", F.lit(1).alias("count"), F.lit(PATTERN).alias("src")))
    if spans is not None:
        recognised = checkpoint(ner_mentions(spans, aliases), "recognised")
        kept = M.retained_candidates(M.candidate_support(recognised, pages), settings["min_candidate_docs"], given_names)
        parts.append(recognised.filter(F.col("src") == NER_KNOWN).unionByName(recognised.filter(F.col("src") == NER_NEW).join(kept, "key", "left_semi")).select("key", "doc_id", "page_no", "count", "src"))
    owned = extracted.join(ids, "relpath")
    refs = owned.select(F.col("id").alias("doc_id"), F.explode("entities").alias("e")).select("doc_id", "e.*")
    pairs = owned.select(F.col("id").alias("doc_id"), F.explode("relations").alias("r"))
    ends = pairs.select("doc_id", F.col("r.type").alias("relation"), F.posexplode(F.array("r.src", "r.dst")).alias("end", "e"), F.xxhash64(F.to_json("r")).alias("rid"))
    resolved = checkpoint(resolve_refs(refs, aliases), "refs")
    parts.append(resolved.select("key", "doc_id", F.lit(1).alias("page_no"), F.lit(0).alias("count"), F.lit(STRUCTURED).alias("src")).distinct())
    mentions_raw = parts[0]
    for more in parts[1:]:
        mentions_raw = mentions_raw.unionByName(more)
    facts = checkpoint(M.mention_facts(M.drop_covered(checkpoint(mentions_raw, "mentions_raw"))), "facts")
    stats = M.entity_ids(M.entity_stats(facts, documents))
    new = resolved.groupBy("key").agg(F.min("name").alias("n_name"), F.min("type").alias("n_type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("n_aliases"))
    entities = stats.join(table.select("key", "name", "type", "aliases", "description", F.col("auto").alias("t_auto")), "key", "left").join(new, "key", "left").select(
        F.col("id").cast("int").alias("id"), "key", F.coalesce("name", "n_name", F.regexp_replace("key", "^[^:]*:", "")).alias("name"), F.coalesce("type", "n_type", F.regexp_extract("key", "^([^:]*):", 1)).alias("type"),
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("aliases", "n_aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("t_auto", F.when(F.col("n_name").isNull(), 1).otherwise(0)).alias("auto"),
        "doc_count", "mention_count", "first_year", "last_year",
    )
    entities = checkpoint(entities, "entities")
    mentions = checkpoint(M.encode(facts, entities.select("key", "id")), "mentions")
    found = E.edges(mentions, entities.select(F.col("id").alias("entity_id"), "doc_count"), documents.count(), settings["window"], settings["max_window_entities"], settings["min_edge_docs"])
    keyed = resolve_refs(ends.select("doc_id", "relation", "rid", "end", "e.*"), aliases)
    a = keyed.filter("end = 0").select("doc_id", "rid", F.col("relation").alias("type"), F.col("key").alias("src_key"))
    b = keyed.filter("end = 1").select("doc_id", "rid", F.col("key").alias("dst_key"))
    evidence = checkpoint(R.relation_docs(a.join(b, ["doc_id", "rid"]), entities.select("key", "id")), "relation_docs")
    meta = spark.createDataFrame([("packs", ",".join(knowledge.packs)), ("ner", str(settings["ner"])), ("title", config.data["title"] or config.id)], "k string, v string")
    meta = meta.unionAll(documents.agg(F.lit("documents").alias("k"), F.count(F.lit(1)).cast("string").alias("v"))).unionAll(pages.agg(F.lit("pages").alias("k"), F.count(F.lit(1)).cast("string").alias("v")))
    return {
        "documents": documents.drop("page_list"), "pages": pages, "entities": entities, "mentions": mentions, "edges": found, "relation_docs": evidence, "relations": R.relation_summary(evidence, documents), "meta": meta,
    }


def _codenames(pages: DataFrame, table: DataFrame, knowledge: Knowledge, words: frozenset[str], spans: DataFrame | None) -> DataFrame:
    """Detected codenames as entities, in the shape of the dictionary."""
    known = table.select(F.explode("aliases").alias("a")).select(F.explode(F.split(F.upper("a"), r"[^A-Z]+")).alias("token")).filter(F.length("token") > 1)
    markings = pages.sparkSession.createDataFrame([(m.upper(),) for m in knowledge.markings], "m string")
    found = CN.detect(pages, known, markings, tuple(sorted(knowledge.stop)), frozenset(w.upper() for w in words))
    if spans is not None:
        people = spans.filter(F.col("label") == "person").select("doc_id", person_udf()(F.col("name")).alias("name")).filter(F.col("name").isNotNull())
        found = CN.surname_veto(found, people)
    more = CN.as_entities(found)
    return more.select("key", "name", "type", "aliases", F.lit("").alias("description"), F.lit(len(knowledge.packs)).alias("pack_ord"), F.lit(0).alias("ord"), "auto")


def status(meta: DataFrame) -> DataFrame:
    """What is built: a row per corpus, a column per key of its meta table."""
    return meta.groupBy("corpus_id").pivot("k").agg(F.first("v")).orderBy("corpus_id")


def top_per_type(entities: DataFrame, k: int = 12) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("doc_count"), "id"))
    return entities.withColumn("rank", rank).filter(F.col("rank") <= k)
