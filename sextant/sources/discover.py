"""Discovery: file listings, include and exclude rules, incremental state."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never read.  Fixed values.
SKIPPED_DIRS = (".git", "__MACOSX", "node_modules", "__pycache__", ".Trash")

#: Format of each file name extension.  Fixed values.
FORMATS = {
    "pdf": "pdf", "txt": "text", "text": "text", "md": "text", "log": "text", "html": "html", "htm": "html", "xhtml": "html",
    "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "xlsm": "xlsx", "odt": "odf", "ods": "odf", "odp": "odf", "csv": "csv", "tsv": "csv",
    "xls": "xls", "rtf": "rtf", "doc": "doc", "eml": "eml", "emlx": "emlx", "msg": "msg", "mbox": "mbox",
    "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image", "gif": "image", "bmp": "image", "json": "json",
}

#: Archive type by suffix.  Fixed values.
ARCHIVES = (
    ("zip", (".zip",)),
    ("tar", (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz", ".tbz2", ".tar.xz", ".txz")),
    ("7z", (".7z",)),
    ("rar", (".rar",)),
)


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for the whole path; * crosses folders, and
    ``dir``, ``dir/`` and ``dir/**`` all mean what is under dir."""
    pattern = pattern.removesuffix("/**").rstrip("/")
    out = ""
    for piece in re.split(r"(\*+|\?|\[[^\]]*\])", pattern):
        if piece.startswith("*"):
            out += ".*"
        elif piece == "?":
            out += "."
        elif piece.startswith("["):
            out += "[" + piece[1:-1].replace("!", "^", 1) + "]" if piece[1:2] == "!" else piece
        else:
            out += re.sub(r"([^\w/ ])", r"\\\1", piece)
    return f"^(?:{out})(?:/.*)?$"


def literal_prefix(pattern: str) -> str:
    """The part of a glob before its first wildcard: folders that differ cannot match."""
    return re.split(r"[*?\[]", pattern, maxsplit=1)[0]


def could_contain(folder: str, includes: list[str]) -> bool:
    """Whether any include may match below a folder."""
    folder = folder.rstrip("/") + "/"
    return not includes or any(p.startswith(folder) or folder.startswith(p) or p == "" for p in map(literal_prefix, includes))


def may_contain(folder: Column, includes: list[str]) -> Column:
    """``could_contain`` as an expression, to leave folders out before they are listed."""
    if not includes:
        return F.lit(True)
    here, out = F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")), F.lit(False)
    for p in map(literal_prefix, includes):
        out = out | (F.lit(True) if p == "" else F.startswith(F.lit(p), here) | F.startswith(here, F.lit(p)))
    return out


def wanted(path: Column, includes: list[str], excludes: list[str]) -> Column:
    """Exclude wins; no include means everything."""
    keep = F.lit(True)
    if includes:
        keep = path.rlike("|".join(map(glob_regex, includes)))
    if excludes:
        keep = keep & ~path.rlike("|".join(map(glob_regex, excludes)))
    return keep


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def format_of(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return pairs[extension(path)]


def archive_type(path: Column) -> Column:
    low, out = F.lower(path), F.lit(None).cast("string")
    for kind, suffixes in ARCHIVES:
        hit = F.lit(False)
        for s in suffixes:
            hit = hit | low.endswith(s)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def looks_like_html(content: Column) -> Column:
    """HTML without an extension: the first 2 KB have an html tag or doctype."""
    head = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    return head.rlike(r"<html|<!doctype html")


def _folders(spark: SparkSession, root: str, includes: list[str]) -> list[str]:
    """The folders that includes name before their first wildcard, if all name one
    that exists; else the root."""
    named = {literal_prefix(p).rpartition("/")[0] for p in includes}
    if not named or "" in named:
        return [root]
    outer = sorted(n for n in named if not any(n.startswith(f"{o}/") for o in named))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{n}") for n in outer]
    return [str(p.toString()) for p in paths] if all(p.getFileSystem(conf).exists(p) for p in paths) else [root]


def list_files(spark: SparkSession, root: str, includes: list[str] = ()) -> DataFrame:
    """``relpath, path, size, mtime`` of every file; contents are not read, nor are
    folders listed that no include names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_folders(spark, root, list(includes))).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    base = re.escape(root.removeprefix("file://").rstrip("/") + "/")
    return files.withColumn("relpath", F.regexp_replace("path", rf"^(?:file:/*)?/?{base.lstrip('/')}", ""))


def discover(files: DataFrame, includes: list[str] = (), excludes: list[str] = (), max_mb: float = 500, archives: bool = True) -> DataFrame:
    """Listing with ``kind`` (format or archive type) and ``reason`` for files that
    are skipped: hidden, excluded, too large or of an unsupported format."""
    parts = F.split("relpath", "/")
    hidden = F.exists(parts, lambda x: x.startswith(".")) | F.arrays_overlap(parts, F.array(*[F.lit(d) for d in SKIPPED_DIRS]))
    kind = F.coalesce(archive_type(F.col("relpath")), format_of(F.col("relpath"))) if archives else format_of(F.col("relpath"))
    rows = files.withColumn("kind", kind)
    reason = (
        F.when(hidden, "hidden")
        .when(~wanted(F.col("relpath"), list(includes), list(excludes)), "excluded")
        .when(F.col("size") > max_mb * 1e6, "too large")
        .when(F.col("kind").isNull(), F.concat(F.lit("unsupported: "), extension(F.col("relpath"))))
    )
    return rows.withColumn("reason", reason)


def skipped(found: DataFrame) -> DataFrame:
    return found.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def page_scans(files: DataFrame, pattern: str = r"^(?<base>.+?)[-_ ]?(?<n>\d{1,4})\.(?:png|jpe?g|tiff?)$") -> DataFrame:
    """Image files that are pages of one document: ``base, files`` in page order,
    with the summed size and the latest change."""
    java = re.sub(r"\(\?P<", "(?<", pattern)
    names = re.findall(r"\(\?<(\w+)>", java)
    rows = files.withColumn("base", F.regexp_extract("relpath", java, names.index("base") + 1)).withColumn("n", F.expr("try_cast(" + f"regexp_extract(relpath, r'{java}', {names.index('n') + 1})" + " as int)"))
    rows = rows.filter((F.col("base") != "") & F.col("n").isNotNull())
    return rows.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("n", "relpath")))["relpath"].alias("files"), F.sum("size").alias("size"), F.max("mtime").alias("mtime"))


def pending(specs: DataFrame, manifest: DataFrame, force: bool = False, only: str | None = None, limit: int | None = None) -> DataFrame:
    """Sources to extract: those whose (relpath, stat) no complete manifest row has."""
    if only:
        specs = specs.filter(F.col("relpath").rlike(glob_regex(only)))
    if not force:
        specs = specs.join(manifest.filter("complete").select("relpath", "stat"), ["relpath", "stat"], "left_anti")
    return specs.orderBy("relpath").limit(limit) if limit else specs


def vanished(manifest: DataFrame, specs: DataFrame) -> DataFrame:
    """Manifest rows whose source is gone: their outputs are garbage."""
    return manifest.join(specs.select("relpath"), "relpath", "left_anti")
