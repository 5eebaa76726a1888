"""Search against SQLite's full-text module, which has the same query language."""

import random
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.operators import search as S

WORDS = "running runner runs national nation relational hope hoping cats cat dogs café resume agreed sky skies happy".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    rows = [(k, f"d{k // 2}", k % 2 + 1, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 25)))) for k in range(120)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(text, tokenize='porter unicode61 remove_diacritics 2')")
    con.executemany("insert into t(rowid, text) values (?, ?)", [(r[0] + 1, r[3]) for r in rows])
    pages = spark.createDataFrame(rows, "page_uid bigint, doc_id string, page_no int, text string").cache()
    docs = spark.createDataFrame([(f"d{k}", f"title {WORDS[k % len(WORDS)]}", 1990 + k % 5, "a" if k % 2 else "b") for k in range(60)], "id string, title string, year int, kind string")
    return S.Index.build(pages, docs), con


QUERIES = ["running", '"running cats"', "nation AND dogs", "cats OR dogs", "cats NOT dogs", "rel*", "NEAR(cats dogs, 2)", "(hope OR sky) AND happy", "hop* NOT cat", "cafe resume", "^cats"]


@pytest.mark.parametrize("query", QUERIES)
def test_same_pages_as_sqlite(corpus, query):
    index, con = corpus
    ours = {r["uid"] + 1 for r in S.matching(index.page_postings, S.parse(query)).collect()}
    assert ours == {r[0] for r in con.execute("select rowid from t where t match ?", (S.rewrite(query),))}


@pytest.mark.parametrize("query", ["running", "nation dogs", "cats OR dogs", '"running cats"'])
def test_same_scores_as_sqlite(corpus, query):
    index, con = corpus
    ours = {r["page_uid"] + 1: r["score"] for r in S.search_pages(index, query).collect()}
    theirs = dict(con.execute("select rowid, bm25(t) from t where t match ?", (S.rewrite(query),)))
    assert ours.keys() == theirs.keys()
    assert all(abs(ours[k] - theirs[k]) < 1e-9 for k in ours)


@pytest.mark.parametrize("query", ['"open', "(cats", "cats AND", "NEAR(cats dogs, x)", "OR cats"])
def test_malformed(corpus, query):
    rows, error = S.safe_search(corpus[0], query)
    assert error and rows.count() == 0


def test_filters_and_entities(spark, corpus):
    index, _ = corpus
    mentions = spark.createDataFrame([(1, "d1", 1, 3), (1, "d2", 1, 1), (2, "d2", 1, 5)], "entity_id int, doc_id string, page_no int, count int")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(S.search(index, "*")) == {f"d{k}" for k in range(60)}
    assert ids(S.search(index, "*", {"kind": "a"}, year_from=1992)) == {f"d{k}" for k in range(60) if k % 2 and k % 5 >= 2}
    assert ids(S.search(index, "", mentions=mentions, entity=1)) == {"d1", "d2"}
    assert ids(S.search(index, "", mentions=mentions, entity=1, entity2=2)) == {"d2"}
    assert ids(S.search(index, "", mentions=mentions, entity2=2)) == {"d2"}
    both = ids(S.search(index, "cats OR dogs OR happy", mentions=mentions, entity=1))
    assert both == ids(S.search(index, "cats OR dogs OR happy")) & {"d1", "d2"}
    assert ids(S.search(index, "cats dogs")) <= ids(S.search(index, "cats OR dogs"))


def test_snippets(spark, corpus):
    index, _ = corpus
    hits = S.search_pages(index, "cats").join(index.pages.select("page_uid", "text"), "page_uid")
    rows = S.snippets(hits.select("doc_id", "page_no", "text", "score"), "cats").collect()
    assert rows and all("[[[cat" in r["snippet"] for r in rows)
    assert index.pages.filter(F.col("text").contains("cat")).count() >= len(rows)


def test_postings_hand_rows_on_by_their_size(spark):
    """A worker holds a bounded number of places, however many texts a batch has, and an
    index reads its postings from files."""
    batch = pd.DataFrame({"uid": range(3000), "texts": [[" ".join(f"w{k}x{n}" for n in range(300))] for k in range(3000)]})
    sizes = [len(f) for f in S.posting_frames(iter([batch]))]
    assert sum(sizes) == 3000 * 301 and max(sizes) <= S.HELD_PLACES + 301 < len(batch) * 301
    pages = spark.createDataFrame([(1, "d", 1, "one text")], "page_uid bigint, doc_id string, page_no int, text string")
    index = S.Index.build(pages, spark.createDataFrame([("d", "t")], "id string, title string"))
    assert index.page_postings.inputFiles() and not index.page_postings.is_cached
    index.close()
