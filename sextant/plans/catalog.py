"""Versioned tables: a build is written beside the last one and becomes current by
a pointer, so readers always see one whole version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.scratch import cut, is_cut


class HeldTables:
    """A catalog of tables that a session holds as DataFrames: what ``api`` reads,
    without a store.  Writing cuts what is not in files already."""

    def __init__(self, spark: SparkSession, tables: dict[str, dict[str, DataFrame]]):
        self.spark, self.tables = spark, tables
        self.versions = dict.fromkeys(tables, "held")

    def corpora(self) -> list[str]:
        return sorted(self.tables)

    def version(self, corpus: str) -> str | None:
        return self.versions.get(corpus)

    def read(self, corpus: str, table: str) -> DataFrame:
        return self.tables[corpus][table]

    def hold(self, corpus: str, tables: dict[str, DataFrame] | None) -> None:
        """A new version of a corpus, or none any more."""
        self.tables.pop(corpus, None)
        self.versions.pop(corpus, None)
        if tables is not None:
            self.tables[corpus], self.versions[corpus] = tables, uuid.uuid4().hex

    def write(self, corpus: str, tables: dict[str, DataFrame]) -> str:
        self.tables[corpus] = {name: df if is_cut(df) else cut(df) for name, df in tables.items()}
        self.versions[corpus] = uuid.uuid4().hex
        return self.versions[corpus]

    def stale(self, stamp: str) -> bool:
        return self.version("_global") is None or self.read("_global", "meta").filter("k = 'stamp'").first()["v"] != stamp

    def stamp(self) -> str:
        return "|".join(f"{c}={self.version(c)}" for c in self.corpora() if not c.startswith("_"))


class Catalog:
    """Tables under ``root/corpus/version``; ``root/corpus/_CURRENT`` names the version.
    All access goes through Hadoop's file systems, so any store will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def corpora(self) -> list[str]:
        p, fs = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and self.version(s.getPath().getName())) if fs.exists(p) else []

    def version(self, corpus: str) -> str | None:
        p, fs = self._fs(f"{self.root}/{corpus}/_CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).strip()
        finally:
            stream.close()

    def write(self, corpus: str, tables: dict[str, DataFrame]) -> str:
        """All tables as a new version, then the pointer: by rename, in one step."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{corpus}/{version}/{name}")
        part, fs = self._fs(f"{self.root}/{corpus}/_CURRENT.{version}")
        out = fs.create(part, True)
        out.write(bytearray(version.encode()))
        out.close()
        current, _ = self._fs(f"{self.root}/{corpus}/_CURRENT")
        if fs.exists(current):
            fs.delete(current, False)
        fs.rename(part, current)
        return version

    def read(self, corpus: str, table: str) -> DataFrame:
        version = self.version(corpus)
        if version is None:
            raise KeyError(f"corpus {corpus!r} is not built")
        return self.spark.read.parquet(f"{self.root}/{corpus}/{version}/{table}")

    def read_all(self, table: str) -> DataFrame:
        """A table of every corpus, with corpus_id; a corpus without it is left out."""
        parts = []
        for corpus in self.corpora():
            p, fs = self._fs(f"{self.root}/{corpus}/{self.version(corpus)}/{table}")
            if fs.exists(p):
                parts.append(self.read(corpus, table).withColumn("corpus_id", F.lit(corpus)))
        if not parts:
            raise KeyError(f"no corpus has {table!r}")
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def drop_old(self, corpus: str) -> int:
        """Versions that are not current are deleted."""
        keep = self.version(corpus)
        p, fs = self._fs(f"{self.root}/{corpus}")
        old = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() != keep]
        for path in old:
            fs.delete(path, True)
        return len(old)

    def stale(self, stamp: str) -> bool:
        """Whether the global index was built from other versions than the stamp's."""
        return self.version("_global") is None or self.read("_global", "meta").filter("k = 'stamp'").first()["v"] != stamp

    def stamp(self) -> str:
        return "|".join(f"{c}={self.version(c)}" for c in self.corpora() if not c.startswith("_"))
