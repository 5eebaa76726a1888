"""Listings as batch and stream sources."""

import json

import pytest

from sextant.sources import listers


def put(folder, cursor, body):
    (folder / listers.response_name(cursor)).write_text(body)


@pytest.fixture
def folder(spark, tmp_path):
    listers.register(spark)
    out = tmp_path / "responses"
    out.mkdir()
    return out


def test_whole_listings(spark, folder):
    for cursor, following in (("*", "a/b?"), ("a/b?", "z"), ("z", None)):
        put(folder, cursor, json.dumps({"items": [cursor], "cursor": following}))
    read = lambda lister: [tuple(r) for r in spark.read.format("listing").option("path", f"file://{folder}").option("lister", lister).load().orderBy("page").select("page", "cursor").collect()]
    assert read("search") == [(0, "*"), (1, "a/b?"), (2, "z")]
    put(folder, "start", "x 1\ny 2\n\nkey one\n")
    put(folder, "key one", "z 3\n")
    assert read("captures") == [(0, "start"), (1, "key one")]
    assert read("posts") == []


def test_a_stream_goes_on_where_it_stopped(spark, folder, tmp_path):
    for k in (1, 2, 3):
        put(folder, str(k), json.dumps([{"id": k}]))

    def run():
        stream = spark.readStream.format("listing").option("path", f"file://{folder}").option("lister", "posts").option("pages_per_batch", "2").load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r["page"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [0, 1, 2]
    assert run() == [0, 1, 2]
    for k in (4, 5, 6):
        put(folder, str(k), json.dumps([{"id": k}] if k < 6 else []))
    assert run() == [0, 1, 2, 3, 4, 5]
    put(folder, "7", json.dumps([{"id": 7}]))  # beyond an empty page: the listing has ended
    assert run() == [0, 1, 2, 3, 4, 5]
