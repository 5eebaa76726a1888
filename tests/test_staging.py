"""Staged documents and attachments."""

import io

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.plans import samples, staging
from sextant.sources import archives


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{k}", "x\ny" * (k % 50) + "é漢\U0001f600", [k, None], None if k % 3 else k) for k in range(400)] + [("d7", "again", None, 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "id string, text string, list array<int>, n bigint").repartition(5)


def test_documents_are_read_by_their_ranges(spark, docs, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/staged"
    staging.write_documents(docs, path, container_bytes=4_000)
    files = spark.read.parquet(f"{path}/index").select("file").distinct().count()
    assert files > 3
    show = lambda df: sorted(map(str, df.collect()))
    assert show(staging.read_documents(spark, path, docs.schema)) == show(docs)
    ids = spark.createDataFrame([("d7",), ("d7",), ("d311",), ("none",)], "id string")
    assert show(staging.read_documents(spark, path, docs.schema, ids)) == show(docs.filter("id in ('d7', 'd311')"))
    assert staging.read_documents(spark, path, docs.schema, ids.filter("id = 'none'")).count() == 0


def test_fetch_reads_only_the_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "GAP_BYTES", 10)
    data = bytes(range(250)) * 40
    (tmp_path / "f").write_bytes(data)
    read = []
    real = staging.pyarrow.fs.FileSystem.from_uri

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def read_at(self, n, at):
            read.append((at, n))
            return self.f.read_at(n, at)

    class System:
        def __init__(self, s):
            self.s = s

        def open_input_file(self, name):
            return Counted(self.s.open_input_file(name))

    monkeypatch.setattr(staging.pyarrow, "fs", type("fs", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(lambda u: (System(real(u)[0]), real(u)[1]))})}))
    got = list(staging.fetch(f"file://{tmp_path}/f", [5, 25, 9_000], [10, 3, 7]))
    assert got == [data[5:15], data[25:28], data[9_000:9_007]] and read == [(5, 10), (25, 3), (9_000, 7)]
    read.clear()
    assert list(staging.fetch(f"file://{tmp_path}/f", [5, 16], [10, 4])) == [data[5:15], data[16:20]] and read == [(5, 15)]


def test_staging_nothing(spark, docs, tmp_path):
    staging.write_documents(docs.limit(0), f"file://{tmp_path}/none")
    assert staging.read_documents(spark, f"file://{tmp_path}/none", docs.schema).count() == 0


def test_an_attachment_of_two_messages_is_stored_once(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    rows = lambda *r: spark.createDataFrame(r, "relpath string, n int, name string, content binary")
    staging.stage_attachments(rows(("m1", 1, "a.txt", b"same"), ("m2", 1, "b.txt", b"same"), ("m2", 2, "c.txt", b"own")), root)
    staging.stage_attachments(rows(("m3", 1, "d.txt", b"same"), ("m3", 2, "e.txt", b"new"), ("m3", 3, "f.txt", b"new")), root)
    stored = lambda: {(bytes(r["content"]), r["references"]) for r in staging.stored_attachments(spark, root).collect()}
    assert stored() == {(b"same", 3), (b"own", 1), (b"new", 2)} and staging.stored_attachments(spark, root).count() == 3
    assert staging.forget(spark, root, spark.createDataFrame([("m2",)], "relpath string")) == 1
    assert stored() == {(b"same", 2), (b"new", 2)}
    assert staging.forget(spark, root, spark.createDataFrame([("m1",), ("m3",)], "relpath string")) == 2 and stored() == set()


def test_attachments_of_mails(spark):
    mail = b'Content-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nbody\r\n--b\r\nContent-Disposition: attachment; filename="x.bin"\r\nContent-Transfer-Encoding: base64\r\n\r\nAAEC\r\n--b--\r\n'
    df = spark.createDataFrame([("a", mail), ("b", b"no mail"), ("c", None)], "relpath string, content binary")
    assert [(r["relpath"], r["n"], r["name"], bytes(r["content"])) for r in staging.mail_attachments(df).select("relpath", "n", "name", F.col("content")).collect()] == [("a", 1, "x.bin", b"\x00\x01\x02")]


def test_members_are_read_in_place(spark, tmp_path, monkeypatch):
    members = [(f"m{k}", bytes([k]) * 300_000 + b"end") for k in range(8)]
    (tmp_path / "a.zip").write_bytes(samples.zipped(members))
    (tmp_path / "a.tar").write_bytes(samples.tarred(members, "w"))
    (tmp_path / "a.tgz").write_bytes(samples.tarred(members))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}", k) for n, k in (("a.zip", "zip"), ("a.tar", "tar"), ("a.tgz", "tar"), ("bad.zip", "zip"), ("gone.zip", "zip"))], "path string, kind string")
    listed = archives.list_members(paths)
    assert listed.count() == 24
    got = {(r["path"].rsplit(".", 1)[-1], r["member"]): bytes(r["content"]) for r in archives.read_member(listed.filter("member in ('m2', 'm7')")).collect()}
    assert got == {(e, m): dict(members)[m] for e in ("zip", "tar", "tgz") for m in ("m2", "m7")}

    read = []

    class Counted(io.FileIO):
        def read(self, n=-1):
            out = super().read(n)
            read.append(len(out))
            return out

        def readinto(self, b):
            n = super().readinto(b)
            read.append(n)
            return n

    monkeypatch.setattr(archives, "_opened", lambda path: Counted(path.removeprefix("file://")))
    for name, kind in (("a.zip", "zip"), ("a.tar", "tar")):
        read.clear()
        (one,) = [(kind, *m) for m in archives.members_at(f"{tmp_path}/{name}", kind) if m[0] == "m5"]
        assert archives.contents_at(f"{tmp_path}/{name}", [one]) == {"m5": dict(members)["m5"]} and sum(read) < 400_000  # of 2,400,000


def test_archives_are_dealt_out_and_opened_once(spark, tmp_path, monkeypatch):
    """Tasks do not depend on how few bytes a row has, and a zip's directory is read once
    for all of its members that are wanted."""
    members = [(f"m{k}", bytes([k])) for k in range(8)]
    (tmp_path / "a.zip").write_bytes(samples.zipped(members))
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.zip", "zip")], "path string, kind string").coalesce(1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = archives.list_members(paths)
    found = archives.read_member(listed)
    assert listed.rdd.getNumPartitions() == parts and found.rdd.getNumPartitions() == parts
    assert {r["member"]: bytes(r["content"]) for r in found.collect()} == dict(members)

    opened, real = [], archives.zipfile.ZipFile
    wanted = [("zip", *m) for m in archives.members_at(f"file://{tmp_path}/a.zip", "zip")]
    monkeypatch.setattr(archives.zipfile, "ZipFile", lambda f: opened.append(f) or real(f))
    assert archives.contents_at(f"file://{tmp_path}/a.zip", wanted) == dict(members) and len(opened) == 1


def test_mails_are_taken_apart_once(spark, tmp_path):
    """Staging reads each mail one time, whatever it settles about its attachments."""
    seen = spark.sparkContext.accumulator(0)

    def attachments(batches):
        for batch in batches:
            seen.add(len(batch))
            yield pd.DataFrame({"relpath": batch["relpath"], "n": 1, "name": "a", "content": [b"x"] * len(batch)}).astype({"n": "int32"})

    mails = spark.createDataFrame([(f"m{k}",) for k in range(20)], "relpath string")
    staging.stage_attachments(mails.mapInPandas(attachments, "relpath string, n int, name string, content binary"), str(tmp_path))
    assert seen.value == 20
