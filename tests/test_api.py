"""Views over built corpora, the global index, and streams."""

import random

import pytest
from pyspark.sql import functions as F

from sextant import api
from sextant import config as C
from sextant.knowledge import demo
from sextant.knowledge.pack import merge
from sextant.plans import build
from sextant.plans.catalog import Catalog, HeldTables
from sextant.scratch import cut
from sextant.sources import records as RC
from sextant.streaming import incremental as ST
from tests import fixtures


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    root, out = str(tmp_path_factory.mktemp("files")), str(tmp_path_factory.mktemp("tables"))
    fixtures.write(root)
    knowledge, catalog = merge(["base"], demo.PACKS), Catalog(spark, out)
    for name, includes in (("one", []), ("two", ["reports", "mail"])):
        cfg = C.from_dict(name, {"root": root, "title": name, "extract": {"include": includes}, "index": {"min_edge_docs": 1}})
        catalog.write(name, build.index(cut(build.extract(spark, cfg)[0]), knowledge, cfg))
        if name == "one":
            lib = api.Library(catalog, 1900, 2100)
            lib.build_global()
            alone = {r["gkey"]: r["doc_count"] for r in lib.table("entities").collect()}
            links = lib.table("links").count()
            local = catalog.read("one", "edges").count()
    return lib, alone, links, local


def test_global_equals_local_for_one_corpus(library):
    lib, alone, links, local = library
    keys = {r["doc_count"] for r in lib.catalog.read("one", "entities").collect()}
    assert set(alone.values()) == keys and links == local


def test_global_merge(library):
    lib, alone, _, _ = library
    assert lib.catalog.stale(lib.catalog.stamp())
    lib.build_global()
    assert not lib.catalog.stale(lib.catalog.stamp()) and lib.build_global() == lib.catalog.version("_global")
    merged = {r["gkey"]: r for r in lib.table("entities").collect()}
    assert merged["person:ada brook"]["n_corpora"] == 2 and merged["person:ada brook"]["doc_count"] == 2 * alone["person:ada brook"]
    total = lib.timeline(["person:ada brook"]).agg(F.sum("value")).first()[0]
    assert total == merged["person:ada brook"]["doc_count"]
    assert lib.overlap().first()["a"] == "one" and lib.also_in("one", "person:Ada Brook").count() == 1
    assert lib.pair("person:ada brook", "person:ben stone").count() == 2
    assert lib.across().count() > 0 and lib.top_documents("person:ada brook").count() == merged["person:ada brook"]["doc_count"]
    assert lib.graph()["links"].count() > 0 and lib.library().count() == 2 and lib.entity("person:ada brook")["presence"].count() == 2


def small_corpus(spark, seed):
    """A corpus of a few entities, two of them spellings of one name."""
    rnd = random.Random(seed)
    names = ["Ada Brook", "ada brook", "Ben Stone", "Tarn", "Norvale", "Orrin Vale"]
    chosen = sorted(rnd.sample(range(6), 4))
    mentions = sorted({(k, f"d{rnd.randrange(8)}") for k in chosen for _ in range(5)})
    docs = {k: len({d for e, d in mentions if e == k}) for k in chosen}
    entities = [(k, f"person:{names[k]}", names[k], "person", "", k % 2, docs[k], docs[k], 1990 + k, 1999, [names[k]]) for k in chosen]
    edges = [(a, b, rnd.randrange(1, 5)) for a in chosen for b in chosen if a < b]
    return {
        "entities": spark.createDataFrame(entities, "id int, key string, name string, type string, description string, auto int, doc_count bigint, mention_count bigint, first_year int, last_year int, aliases array<string>"),
        "mentions": spark.createDataFrame(mentions, "entity_id int, doc_id string").withColumn("count", F.lit(1)),
        "documents": spark.createDataFrame([(f"d{k}", 1990 + k) for k in range(8)], "id string, year int").withColumn("pages", F.lit(1)),
        "edges": spark.createDataFrame(edges, "src int, dst int, docs bigint"),
    }


def test_incremental_merge_equals_a_full_build(spark):
    held = HeldTables(spark, {k: small_corpus(spark, n) for n, k in enumerate("abc")})
    lib = api.Library(held, 1900, 2100)
    assert lib.current(required=False) is None
    lib.current()
    old = lib.table("links")
    changes = [("d", small_corpus(spark, 9), "d"), ("b", small_corpus(spark, 10), "b"), ("a", None, "")]
    for name, tables, read in changes:
        held.hold(name, tables)
        lib.build_global()
        assert lib.table("meta").filter("k = 'read'").first()["v"] == read
    show = lambda x: {t: sorted(map(str, x.table(t).select(*sorted(x.table(t).columns)).collect())) for t in ("entities", "links", "variants", "years", "type_counts")}
    full = api.Library(HeldTables(spark, {k: v for k, v in held.tables.items() if k != "_global"}), 1900, 2100)
    full.build_global()
    assert show(lib) == show(full)
    assert old.count() > 0  # a reader of the first version still has it


def test_a_failed_build_is_not_tried_at_once(spark, monkeypatch):
    lib = api.Library(HeldTables(spark, {"a": {}}), 1900, 2100)
    with pytest.raises(KeyError):
        lib.current()
    with pytest.raises(RuntimeError, match="next attempt"):
        lib.current()
    monkeypatch.setattr(api, "BACKOFF", 0)
    with pytest.raises(KeyError):
        lib.current()


def test_corpus_views(library):
    lib = library[0]
    c = api.Corpus(lib.catalog, "one", 1900, 2100)
    found = c.search("norvale")
    assert found["error"] is None and found["total"] == found["results"].count() > 0
    one = found["results"].first()["id"]
    assert c.document(one)["document"].count() == 1
    names = {r["name"]: r["id"] for r in c.entities().collect()}
    ada = names["Ada Brook"]
    assert c.entity(ada)["documents"].count() == 3 and c.autocomplete("ada").first()["id"] == ada
    assert c.graph()["links"].count() > 0 and c.graph(focus=ada)["links"].count() > 0 and c.graph(source="relations")["links"].count() == 1
    assert c.timeline([ada], share=True).agg(F.max("value")).first()[0] <= 100
    assert all(df.count() >= 0 for df in c.overview().values()) and c.docs_with_all([ada, names["Ben Stone"]]).count() == 3
    assert lib.search_all("norvale").select("corpus_id").distinct().count() == 2
    assert c.search("(")["error"] and c.search("*", order="date_asc", page=2)["results"].count() == 0


def test_chat_and_dump_records(spark):
    files = spark.createDataFrame([(f"chat/{k}", v) for k, v in fixtures.CHATS.items()], "relpath string, text string")
    messages = cut(RC.chat_messages(files))
    days = {(r["conversation"], r["day"]): r["text"] for r in RC.conversations(messages).collect()}
    assert days[("ada ↔ ben", "2020-01-01")] == "[00:00:00] ben → ada: early\n[23:30:00] ada → ben: late"
    assert days[("Crew", "2020-01-01")] == "[10:00:00] Ada: hello all" and days[("harbour", "2020-01-03")] == "[00:00:00] Cy Dale: hi"
    assert RC.messaged(messages).count() == 3
    rows = RC.sql_rows(spark.createDataFrame([("d.sql", fixtures.DUMP)], "relpath string, text string"), "log", unescape=True).orderBy("row_no").collect()
    assert [r["values"]["Title"] for r in rows] == ['It\'s "one"', "a'b"] and rows[0]["values"]["Summary"] == "Tom & Jerry"
    assert rows[1]["values"]["Date"] is None and rows[1]["values"]["Summary"] == "x,(y)"
    config = RC.RecordConfig("log", "ReportKey", ("Title", "Summary"), title="{ReportKey}: {Title}", date="Date", entities={"Region": ("place", None)})
    docs = RC.row_documents(RC.value_columns(RC.sql_rows(spark.createDataFrame([("d.sql", fixtures.DUMP)], "relpath string, text string"), "log"), ["ReportKey", "Date", "Title", "Summary", "Region"]), config, "d.sql").orderBy("relpath").collect()
    assert docs[0]["relpath"] == "d.sql#k1" and docs[0]["doc_date"] == "2004-01-02" and docs[0]["entities"][0]["name"] == "North" and docs[1]["doc_date"] == ""


def test_registry(spark):
    nodes = RC.registry_nodes(spark.createDataFrame([("1", "Gull Shipping Ltd", "x", "2001-02-03"), ("2", "", "x", None)], "node_id string, name string, sourceID string, incorporation_date string"), "Offshore entity", "company")
    nodes = nodes.unionByName(RC.registry_nodes(spark.createDataFrame([("3", "Ada Brook", "x"), ("4", "Tarn Holdings Ltd", "x"), ("5", "Out", "other")], "node_id string, name string, sourceID string"), "Officer", "person", ["X"]))
    edges = RC.registry_edges(spark.createDataFrame([("3", "1", "director_of", "2001", None), ("3", "9", "x", None, None)], "node_id_start string, node_id_end string, rel_type string, start_date string, end_date string"), nodes)
    docs = {r["node_id"]: r for r in RC.registry_documents(nodes, edges).collect()}
    assert set(docs) == {"1", "3", "4"} and docs["4"]["type"] == "company" and docs["3"]["type"] == "person" and docs["1"]["doc_date"] == "2001-02-03"
    assert "- director of → Gull Shipping Ltd (offshore entity) [2001 –]" in docs["3"]["text"] and docs["1"]["neighbours"] == ["3"]


def test_streams(spark, tmp_path):
    fixtures.write(str(tmp_path / "in"))
    done = lambda: ST.write_extracted(ST.new_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    done()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    (tmp_path / "in" / "late.txt").write_text("arrived late")
    done()
    assert spark.read.parquet(str(tmp_path / "out")).count() == first + 1
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = ST.windowed(events, "1 day").writeStream.outputMode("append").format("memory").queryName("by_day").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert 0 < spark.table("by_day").agg(F.sum("n")).first()[0] <= batch


def test_a_corpus_and_its_share_of_the_index_are_written_once(spark, sf):
    """Tables that others follow from come from files, so none is made again for each."""
    from sextant.plans import registry_more
    from sextant.scratch import is_cut

    tables = registry_more._orders_corpus(spark, sf, "2-HIGH")
    library = api.Library(HeldTables(spark, {"2-HIGH": tables}), 1900, 2100)
    assert all(is_cut(df) for df in [*tables.values(), *library._parts(["2-HIGH"]).values()])
