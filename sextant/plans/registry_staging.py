"""Registered queries of staging, attachments and the incremental global index."""

from __future__ import annotations

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant import api
from sextant.plans import staging, star
from sextant.plans.catalog import HeldTables
from sextant.plans.registry import _docs, _query
from sextant.plans.registry_more import _orders_corpus
from sextant.scratch import fresh_path
from sextant.sources import links, listers


@_query("SELECT doc_id, lang, n_chars, md5(coalesce(text, '')) AS md5 FROM documents")
def staged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to containers and read back by their byte ranges."""
    docs, path = _docs(spark, sf_dir), fresh_path(spark, "staged")
    staging.write_documents(docs, path, "doc_id", 1 << 20)
    found = staging.read_documents(spark, path, docs.schema)
    return found.select("doc_id", "lang", "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))


@_query("""WITH a AS (SELECT 'segment ' || c_mktsegment AS content FROM customer UNION ALL SELECT 'nation ' || c_nationkey FROM customer)
SELECT sha1(content) AS sha1, content, count(*) AS "references" FROM a GROUP BY content""")
def stored_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails with two attachments each, whose contents many share; staged in two runs."""
    c = star.read(spark, sf_dir, "customer")
    part = lambda name, text: F.concat(F.lit(f'--b\r\nContent-Type: text/plain; name="{name}"\r\nContent-Disposition: attachment; filename="{name}"\r\nContent-Transfer-Encoding: base64\r\n\r\n'), F.base64(text.cast("binary")), F.lit("\r\n"))
    head = F.lit('From: a@x.org\r\nTo: b@x.org\r\nSubject: s\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nbody\r\n')
    mail = F.concat(head, part("segment.txt", F.concat(F.lit("segment "), "c_mktsegment")), part("nation.txt", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))), F.lit("--b--\r\n"))
    mails = c.select(F.concat("c_name", F.lit(".eml")).alias("relpath"), mail.cast("binary").alias("content"))
    root, even = fresh_path(spark, "attachments"), F.pmod(F.xxhash64("relpath"), F.lit(2)) == 0
    for run in (even, ~even):
        staging.stage_attachments(staging.mail_attachments(mails.filter(run)), root)
    return staging.stored_attachments(spark, root).select("sha1", F.col("content").cast("string").alias("content"), "references")


_AFTER = """d AS (SELECT o_orderkey AS id, o_orderpriority AS cid, year(o_orderdate)::INT AS year FROM orders WHERE o_orderpriority = '3-MEDIUM' OR (o_orderpriority = '2-HIGH' AND year(o_orderdate) >= 1995)),
m AS (SELECT DISTINCT cid, year, id AS doc_id, l_suppkey AS s FROM lineitem JOIN d ON id = l_orderkey),
per AS (SELECT cid, s, count(*) AS docs, min(year)::INT AS first_year, max(year)::INT AS last_year FROM m GROUP BY ALL)"""


def _after_changes(spark: SparkSession, sf_dir: str) -> api.Library:
    """A global index after a corpus was added, one rebuilt and one removed."""
    built = lambda *which: _orders_corpus(spark, sf_dir, *which)
    library = api.Library(HeldTables(spark, {k: built(k) for k in ("1-URGENT", "2-HIGH")}), 1900, 2100)
    library.build_global()
    library.catalog.hold("3-MEDIUM", built("3-MEDIUM"))
    library.build_global()
    library.catalog.hold("2-HIGH", built("2-HIGH", 1995))
    library.catalog.hold("1-URGENT", None)
    library.build_global()
    return library


@_query(f"""WITH {_AFTER} SELECT 'company:' || lower(s_name) AS gkey, s_name AS name, sum(docs)::BIGINT AS doc_count, count(*) AS n_corpora, min(first_year) AS first_year, max(last_year) AS last_year
FROM per JOIN supplier ON s = s_suppkey GROUP BY ALL""")
def incremental_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after_changes(spark, sf_dir).table("entities").select("gkey", "name", "doc_count", "n_corpora", "first_year", "last_year")


@_query(f"""WITH {_AFTER}, w AS (SELECT DISTINCT cid, l_orderkey AS doc_id, (l_linenumber - 1) // 5 AS w, l_suppkey AS s FROM lineitem JOIN d ON id = l_orderkey),
p AS (SELECT DISTINCT x.cid, x.doc_id, least(a.s_name, b.s_name) AS a, greatest(a.s_name, b.s_name) AS b FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND x.s <> y.s JOIN supplier a ON a.s_suppkey = x.s JOIN supplier b ON b.s_suppkey = y.s),
c AS (SELECT cid, a, b, count(*) AS docs FROM p GROUP BY ALL HAVING count(*) >= 2)
SELECT 'company:' || lower(a) AS a, 'company:' || lower(b) AS b, sum(docs)::BIGINT AS docs, count(*) AS n_corpora FROM c GROUP BY ALL""")
def incremental_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after_changes(spark, sf_dir).table("links").select("a", "b", "docs", "n_corpora")


@_query("SELECT 'part' || p_partkey AS identifier, p_partkey % 10 || '/part' || p_partkey || s AS path FROM part, (VALUES ('.pdf'), ('_text.txt')) v(s)")
def listed_by_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing read page after page by the cursors that its responses name."""
    part = star.read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).cast("int").alias("page"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("identifier"))
    last = F.max("page").over(Window.partitionBy())  # a row per page
    cursor = lambda page: F.concat(F.lit("c/"), page.cast("string"))
    pages = part.groupBy("page").agg(F.collect_list(F.struct("identifier")).alias("items")).withColumn("last", last)
    body = F.to_json(F.struct("items", F.when(F.col("page") < F.col("last"), cursor(F.col("page") + 1)).alias("cursor")))
    path = fresh_path(spark, "listing")

    def store(batches):
        system, folder = pyarrow.fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for name, text in zip(batch["name"], batch["body"], strict=True):
                with system.open_output_stream(f"{folder}/{listers.response_name(name)}") as f:
                    f.write(text.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    pages.select(F.when(F.col("page") == 0, "*").otherwise(cursor(F.col("page"))).alias("name"), body.alias("body")).mapInPandas(store, "n int").agg(F.sum("n")).first()
    listers.register(spark)
    found = spark.read.format("listing").option("path", path).option("lister", "search").load()
    return links.search_items(found.select("page", "body"), (".pdf", "_text.txt"), r"(\d)$")
