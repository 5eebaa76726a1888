"""The pipeline's stages on awkward rows, each against plain Python on its own input."""

import pytest

import corpus_pipeline as P
from sextant.llm import langid
from sextant.llm.common import materialise
from tests.llm.test_operators import jaccard_groups, repeats_reference


@pytest.fixture(scope="module")
def stages(spark, awkward):
    docs, out = awkward, [awkward]
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, ""), "test-" + name.replace(" ", "-"))
        out.append(docs)
    return out


def ids(df):
    return sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(tuple(d.columns) == P.COLUMNS for d in stages[1:-1])


def test_language_stage(stages):
    found = langid.predict(stages[0], langid.train(stages[0])).filter("not rejected")
    assert ids(stages[1]) == ids(found) and not {"3", "4", "5", "6"} & set(ids(stages[1]))


def test_near_dedup_stage(stages):
    texts = dict(map(tuple, stages[1].select("doc_id", "text").collect()))
    kept = ids(stages[2])
    assert len(kept) == len(set(kept)) == len(set(texts.values())) and "2" not in kept and "1" in kept


def test_near_dedup_equals_brute_force(spark):
    """Of the groups that comparing all pairs finds, the smallest id of each stays."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    least = jaccard_groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    wordless = sorted(d for d, t in texts.items() if not (t or "").split())
    want = {d for d, low in least.items() if d == low} - set(wordless[1:])
    assert {r["doc_id"] for r in P.near_dedup(spark, docs, "").collect()} == want


def test_near_dedup_chooses_by_row(spark):
    """Rows without an id, and different texts of one id, each stay or go by their own group."""
    text = lambda name, extra="": " ".join(f"{name}{k}" for k in range(60)) + extra
    docs = [(None, text("a")), (None, text("b")), (None, text("b", " end")), (None, text("c")), (1, text("c")), (5, text("c", " end")), (5, text("d")), (5, text("d")), (7, text("e"))]
    table = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    kept = [(r["doc_id"], r["text"].split()[0]) for r in P.near_dedup(spark, table, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, "a0"), (None, "b0"), (1, "c0"), (5, "d0"), (7, "e0")], key=str)


def test_substring_stage(stages):
    want = {d: (kept, gone) for d, _, gone, kept in repeats_reference([tuple(r) for r in stages[2].select("doc_id", "text").collect()], 13)}
    before = dict(map(tuple, stages[2].select("doc_id", "text").collect()))
    for r in stages[3].collect():
        kept, gone = want[r["doc_id"]]
        assert r["text"] == (kept if gone else before[r["doc_id"]])
    assert len(ids(stages[3])) == sum(1 for kept, gone in want.values() if not gone or kept)


def test_mixing_and_packing_stages(stages):
    assert set(ids(stages[4])) <= set(ids(stages[3]))
    assert set(ids(stages[5])) == set(ids(stages[4]))
    lengths = stages[5].groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 2048 for r in lengths)


def test_run_on_an_empty_table(spark, nothing):
    docs = nothing
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
