"""From files to tables: discovery, formats, metadata, entities, relations, increments."""

import pytest
from pyspark.sql import functions as F

from sextant import config as C
from sextant.knowledge import demo
from sextant.knowledge.pack import Pack, merge, order
from sextant.plans import build
from sextant.plans.catalog import Catalog
from sextant.scratch import cut
from sextant.sources import discover
from tests import fixtures


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    fixtures.write(root)
    cfg = C.from_dict("demo", {"root": root, "title": "Demo", "index": {"min_edge_docs": 1}})
    knowledge = merge(["base"], demo.PACKS)
    extracted, listing = build.extract(spark, cfg)
    extracted, listing = cut(extracted), cut(listing)
    tables = build.index(extracted, knowledge, cfg)
    return cfg, extracted, listing, tables


def test_discovery(corpus):
    _, _, listing, _ = corpus
    skipped = {r["reason"]: r["n"] for r in discover.skipped(listing).collect()}
    assert skipped == {"unsupported: bin": 1}  # hidden folders are not listed at all


def test_formats(corpus):
    _, extracted, _, _ = corpus
    rows = {r["relpath"]: r for r in extracted.collect()}
    text = {k: [p["text"] for p in r["pages"]] for k, r in rows.items()}
    assert text["office/notes.docx"] == text["office/renamed.doc"] == ["First page of Norvale", "Second page"]
    assert text["office/boats.xlsx"] == ["[Boats]\nname\ttons\nGull\t42"]
    assert text["office/talk.pptx"] == ["first", "second", "tenth"]
    assert text["office/open.odt"] == ["Heading\nOpen text"]
    assert text["office/table.csv"] == ["a\tb\n1\t2\n3\t4"]
    assert text["office/old.rtf"] == ["Rich text\nnext"]
    assert text["web/page.html"] == ["Dock & quay\n Café"] and text["web/latin.html"] == ["Café"]
    assert text["packed.zip!/in/paper.txt"] == ["Zipped Norvale text"] and "packed.zip!/in/tool.exe" not in text
    assert text["packed.tar.gz!/t/page.html"] == ["Tarred page"]
    assert rows["office/broken.docx"]["error"] and text["office/broken.docx"] == [""]
    assert text["mail/one.eml"][1] == "attached words" and rows["mail/one.eml"]["doc_date"] == "1962-02-03"
    assert rows["mail/box.mbox#1"]["title"] == "Re 1"
    assert "BadZipFile" in rows["torn.zip"]["error"] and text["torn.zip"] == [""] and rows["packed.zip!/in/paper.txt"]["member"] == "in/paper.txt"


def test_recognised_text(spark, corpus):
    _, extracted, _, _ = corpus
    text = spark.createDataFrame([("other/scan.png", 1, "seen on a scan")], "relpath string, page_no int, ocr_text string")
    for cache, want in ((text, ("seen on a scan", 1, True)), (text.limit(0), ("", 0, False))):
        rows = {r["relpath"]: r for r in build.with_ocr(extracted, cache).collect()}
        page = rows["other/scan.png"]["pages"][0]
        assert (page["text"], page["ocr"], rows["other/scan.png"]["complete"]) == want and rows["office/talk.pptx"]["complete"]


def test_codenames_and_candidates_reach_the_index(spark):
    """A word in capitals becomes a program, unless it is a surname; recognised names
    resolve to known entities, stay if enough documents have them, or go."""
    texts = ["Plan MOONRAKER began. Ada Brook met Tarn Mills Ltd.", "Then MOONRAKER ended. Ada Brook left; John GULLWING stayed.", "John GULLWING and Ben Stone wrote."]
    pages = [(f"d/{k}.txt", "text", [(1, t, 0)]) for k, t in enumerate(texts)]
    none = F.lit(None).cast("string")
    docs = spark.createDataFrame(pages, "relpath string, kind string, pages array<struct<n:int,text:string,ocr:int>>")
    ref = "struct<type:string,name:string,key:string,aliases:array<string>,description:string,source:string>"
    docs = docs.select("*", *[none.alias(c) for c in ("title", "author", "doc_date", "origin", "classification", "member", "collection", "error")], F.lit(None).cast("map<string,string>").alias("fields"), F.lit(None).cast(f"array<{ref}>").alias("entities"), F.lit(None).cast(f"array<struct<src:{ref},type:string,dst:{ref}>>").alias("relations"), F.lit(None).cast("array<string>").alias("attachments"))
    names = lambda p: p.select("doc_id", "page_no", F.explode(F.regexp_extract_all("text", F.lit("(?:Ada|Ben|John) [A-Za-z]+|Tarn Mills"), F.lit(0))).alias("name")).withColumn("label", F.when(F.col("name").startswith("Tarn"), "organization").otherwise("person"))
    tables = build.index(docs, merge(["base"], demo.PACKS), C.from_dict("x", {"index": {"min_edge_docs": 1}}), ner=names)
    found = {r["key"]: (r["auto"], r["doc_count"]) for r in tables["entities"].collect()}
    assert found == {"program:MOONRAKER": (1, 2), "person:Ada Brook": (1, 2), "person:John Gullwing": (1, 2), "company:Tarn Mills": (0, 1)}


def test_only_named_folders_are_listed(spark, corpus):
    cfg = corpus[0]
    listed = {r["relpath"] for r in discover.list_files(spark, cfg.root, ["office/*.docx", "mail/one*"]).collect()}
    assert {p.split("/")[0] for p in listed} == {"office", "mail"} and "office/notes.docx" in listed
    assert discover.list_files(spark, cfg.root, ["reports", "x/*"]).count() == discover.list_files(spark, cfg.root).count()


def test_metadata(corpus):
    docs = {r["relpath"]: r for r in corpus[3]["documents"].collect()}
    report = docs["reports/1962-02-03 quay.txt"] if "reports/1962-02-03 quay.txt" in docs else docs["reports/copy of quay.txt"]
    assert report["duplicates"] and report["classification"] == "Private" and report["origin"] == "Harbour Board"
    assert report["doc_date"] in ("1962-02-03", "1962-01-28") and report["year"] == 1962
    assert docs["packed.zip!/in/paper.txt"]["collection"] == "packed" and docs["web/page.html"]["collection"] == "web"
    assert docs["mail/one.eml"]["title"] == "Slip ways" and docs["mail/one.eml"]["fields"]["Attachments"] == "note.txt"
    assert docs["packed.tar.gz!/t/page.html"]["title"] == "Tarred page"


def test_entities_and_relations(corpus):
    tables = corpus[3]
    keys = {r["key"]: r for r in tables["entities"].collect()}
    assert {"place:Norvale", "company:Tarn Mills", "organization:Harbour Board", "person:Ada Brook", "identifier:DE89370400440532013000", "identifier:+49301234567", "idea:licensing"} <= set(keys)
    assert keys["place:Norvale"]["doc_count"] == 3
    relations = tables["relations"].join(tables["entities"].select(F.col("id").alias("src"), F.col("key").alias("s")), "src").join(tables["entities"].select(F.col("id").alias("dst"), F.col("key").alias("d")), "dst")
    found = {(r["s"], r["type"], r["d"]): r["docs"] for r in relations.collect()}
    assert found == {("person:Ada Brook", "emailed", "person:Ben Stone"): 1, ("person:Ben Stone", "emailed", "person:Ada Brook"): 2}
    edges = tables["edges"].collect()
    assert edges and all(r["src"] < r["dst"] and r["npmi"] <= 1 for r in edges)


def test_incremental_and_catalog(spark, corpus, tmp_path):
    cfg, _, listing, tables = corpus
    done = listing.filter("reason is null").select("relpath", F.concat_ws(":", "size", F.col("mtime").cast("string")).alias("stat"), F.lit(True).alias("complete"))
    again, _ = build.extract(spark, cfg, done)
    assert again.count() == 0
    assert discover.vanished(done, listing.filter("relpath not like 'mail/%'")).count() == 2
    catalog = Catalog(spark, str(tmp_path))
    catalog.write("demo", {"meta": tables["meta"], "documents": tables["documents"]})
    first = catalog.version("demo")
    catalog.write("demo", {"meta": tables["meta"]})
    assert catalog.version("demo") != first and catalog.drop_old("demo") == 1 and catalog.corpora() == ["demo"]
    assert build.status(catalog.read_all("meta")).first()["documents"] == str(tables["documents"].count())


def test_packs():
    k = merge(["docks"], demo.PACKS)
    assert k.packs == ["base", "docks"] and k.min_hits == 2
    assert k.entities["place:Norvale"]["aliases"] == ["Norvale", "Norvale City", "Old Norvale"] and k.entities["place:Norvale"]["description"] == "A harbour town."
    assert "TM2" not in k.entities["company:Tarn Mills"]["aliases"]
    assert "TM2" in merge(["docks"], demo.PACKS, keep=("TM2",)).entities["company:Tarn Mills"]["aliases"]
    with pytest.raises(ValueError):
        order(["a"], {"a": Pack("a", ("b",)), "b": Pack("b", ("a",))})


def test_pack_conflicts(spark):
    rows = merge(["docks"], demo.PACKS).conflicts(spark).collect()
    assert [(r["alias"], r["owner"], r["claimed_by"]) for r in rows] == [("HARB", "organization:Harbour Board", "agency:Dock Office")]


def test_config(tmp_path):
    (tmp_path / "one.toml").write_text('id = "uno"\n[dates]\nmin_year = 1950\n')
    (tmp_path / "bad.toml").write_text("= nonsense")
    (tmp_path / "_template.toml").write_text("")
    found, errors = C.load_all(tmp_path)
    assert [c.id for c in found] == ["uno"] and list(errors) == ["bad"]
    assert found[0]["dates"]["text_min_year"] == 1950 and found[0]["index"]["window"] == 5
    with pytest.raises(KeyError, match="one"):
        C.load("none", tmp_path)
    watched = C.Watched(tmp_path)
    assert len(watched.get()[0]) == 1
