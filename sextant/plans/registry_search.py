"""Registered full-text queries: text with facets and entities, columns, snippets, and
the first hits of a stored index, each with its SQL.

The terms asked for are such that stemming brings few words to them, so that SQL can
name these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import search as SE
from sextant.plans import star
from sextant.plans.registry import _STATS, _docs, _edges, _query
from sextant.scratch import fresh_path

_TOKENS = "regexp_extract_all(lower(strip_accents({})), '[\\p{{L}}\\p{{N}}]+')"


def _score_sql(texts: str, terms: dict[str, tuple[str, ...]], scoring: list[str] | None = None) -> str:
    """CTEs ``tf`` (a column per term) and ``scored`` (uid, score, a column per term)
    over ``texts`` (uid, w: the list of a text's tokens); scoring: terms that count."""
    counts = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)})))::DOUBLE AS {t}" for t, words in terms.items())
    dfs = ", ".join(f"count(*) FILTER ({t} > 0) AS df_{t}" for t in terms)
    part = " + ".join(
        f"CASE WHEN {t} > 0 THEN greatest(CASE WHEN n > df_{t} THEN ln((n - df_{t} + 0.5::DOUBLE) / (df_{t} + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END, 1e-6::DOUBLE) * {t} * 2.2::DOUBLE / ({t} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / average)) ELSE 0 END" for t in scoring or terms
    )
    return f"""tf AS (SELECT uid, len(w)::DOUBLE AS len, {counts} FROM {texts}),
st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS average, {dfs} FROM tf),
scored AS (SELECT tf.*, -({part}) AS score FROM tf, st)"""


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as pages of their own, with a title, a file name and an author."""
    d = _docs(spark, sf_dir)
    pages = d.select(F.col("doc_id").alias("page_uid"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_no"), "text")
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "en ").otherwise("file "), F.col("doc_id").cast("string"))
    docs = d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), name.alias("filename"), F.col("lang").alias("author"), F.col("lang").alias("kind"), F.lit(2000).alias("year"))
    return pages, docs


_TH = {"th": ("th", "ths"), "nd": ("nd", "nds"), "st": ("st", "sts")}


@_query(f"""WITH t AS (SELECT doc_id AS uid, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents), {_score_sql("t", _TH, ["th", "nd"])}
SELECT uid::VARCHAR AS doc_id, round(score, 6) AS score FROM scored JOIN documents d ON d.doc_id = uid WHERE th > 0 AND nd > 0 AND st = 0 AND lang = 'en'""")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that must and must not occur, within one facet."""
    index = SE.Index.build(*_texts(spark, sf_dir))
    return SE.search(index, "th AND nd NOT st", {"kind": "en"}).select("doc_id", F.round("score", 6).alias("score"))


@_query(f"""WITH s AS (SELECT doc_id AS uid, CASE WHEN lang = 'en' THEN ['a'] ELSE ['x'] END || CASE WHEN source = 'src3' THEN ['b'] ELSE ['x'] END || ['x', 'x'] AS w FROM documents), {_score_sql("s", {"a": ("a",), "b": ("b",)})}
SELECT uid::VARCHAR AS doc_id, round(3 * score, 6) AS score FROM scored WHERE a > 0 OR b > 0""")
def search_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column alone: a file name that has the author's word does not count."""
    index = SE.Index.build(*_texts(spark, sf_dir))
    return SE.search(index, "author:en OR title:src3").select("doc_id", F.round("score", 6).alias("score"))


@_query(f"""WITH t AS (SELECT doc_id AS uid, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents), {_score_sql("t", _TH)}
SELECT uid::VARCHAR AS doc_id, round(score, 6) AS score FROM scored WHERE th > 0 OR nd > 0 OR st > 0 ORDER BY scored.score, uid LIMIT 50""")
def search_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hits of an index in files, by the bounds of its blocks."""
    pages, docs = _texts(spark, sf_dir)
    path = fresh_path(spark, "index")
    SE.StoredIndex.write(path, pages, docs)
    return SE.top_pages(SE.StoredIndex.open(path, pages, docs), "th OR nd OR st", 50).select("doc_id", F.round("score", 6).alias("score"))


_LINES = """l AS (SELECT l_orderkey AS o, l_linenumber AS line, string_agg(p_name, ' ' ORDER BY p_name) AS text FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
t AS (SELECT o, line, o * 100 + line AS uid, text, string_split(text, ' ') AS w FROM l)"""


def _lines(spark: SparkSession, sf_dir: str) -> SE.Index:
    """An order is a document, a line number its page, the parts' names the text."""
    line = star.read(spark, sf_dir, "lineitem").join(star.read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    text = line.groupBy("l_orderkey", "l_linenumber").agg(F.array_join(F.sort_array(F.collect_list("p_name")), " ").alias("text"))
    pages = text.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("page_uid"), F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("page_no"), "text")
    return SE.Index.build(pages, star.documents(spark, sf_dir))


@_query(f"""WITH {_STATS}, {_LINES}, {_score_sql("t", {"hot": ("hot",), "plate": ("plate",)})},
h AS (SELECT (uid // 100)::VARCHAR AS doc_id, sum(score) AS score, array_to_string(list_sort(list(uid % 100)), ',') AS pages FROM scored WHERE hot > 0 AND plate > 0 GROUP BY 1)
SELECT doc_id, round(score, 6) AS score, pages, doc_date FROM h JOIN docs ON docs.id = doc_id JOIN orders ON o_orderkey::VARCHAR = doc_id
WHERE o_orderstatus = 'O' AND year >= 1995 AND doc_id IN (SELECT doc_id FROM ment WHERE entity_id <= 20 AND entity_id = 2)""")
def search_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with a facet, years, and an entity that the document must mention."""
    _, _, mentions = _edges(spark, sf_dir)
    found = SE.search(_lines(spark, sf_dir), "hot plate", {"kind": "O"}, year_from=1995, mentions=mentions, entity=2)
    return found.select("doc_id", F.round("score", 6).alias("score"), F.array_join("pages", ",").alias("pages"), "doc_date")


@_query(f"""WITH {_LINES}, {_score_sql("t", {"plate": ("plate",)})}, top AS (SELECT uid, score FROM scored WHERE plate > 0 ORDER BY score, uid LIMIT 600)
SELECT (uid // 100)::VARCHAR AS doc_id, round(sum(score), 6) AS score, count(*)::INT AS n_pages FROM top GROUP BY 1""")
def search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 600 first page hits, as a search over all corpora takes them."""
    found = SE.search(_lines(spark, sf_dir), "plate", page_cap=600)
    return found.select("doc_id", F.round("score", 6).alias("score"), F.size("pages").alias("n_pages"))


@_query(f"""WITH {_LINES} SELECT o::VARCHAR AS doc_id, line::INT AS page_no, regexp_replace(text, '\\b(hot|ring)\\b', '[[[\\1]]]', 'g') AS snippet FROM t
WHERE list_contains(w, 'hot') AND list_contains(w, 'ring') AND o % 2 = 0""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts around the hits, with marks."""
    index = _lines(spark, sf_dir)
    hits = SE.search_pages(index, "hot AND ring").join(index.pages.select("page_uid", "text"), "page_uid").filter("cast(doc_id as bigint) % 2 = 0")
    return SE.snippets(hits, "hot AND ring", per_doc=100)


@_query(f"""WITH q AS (SELECT c_custkey AS k, ['hot plate', '"open', 'hot AND', 'NEAR(hot ring, x)', '(hot'][c_custkey % 5 + 1] AS query FROM customer)
SELECT k, query, query <> 'hot plate' AS malformed FROM q""")
def search_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that do not parse are told from those that do."""
    asked = F.element_at(F.array(*map(F.lit, ("hot plate", '"open', "hot AND", "NEAR(hot ring, x)", "(hot"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = star.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), asked.alias("query"))
    return rows.withColumn("malformed", SE.malformed_udf()("query"))
