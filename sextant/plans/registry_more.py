"""More registered queries: sources, formats, records, metadata, names and views, each
with its SQL equivalent over the same tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant import api
from sextant import config as CF
from sextant.functions import dates as DT
from sextant.functions import fold as FO
from sextant.functions import names as NM
from sextant.functions import text as TX
from sextant.knowledge import demo
from sextant.knowledge.pack import merge
from sextant.operators import codenames as CN
from sextant.operators import documents as D
from sextant.operators import edges as E
from sextant.operators import globalindex as G
from sextant.operators import graph as GR
from sextant.operators import matcher as MA
from sextant.operators import mentions as M
from sextant.operators import metadata as MD
from sextant.operators import search as SE
from sextant.operators import timeline as T
from sextant.plans import build, samples, star
from sextant.plans.catalog import HeldTables
from sextant.plans.registry import _CAPS, _EDGES, _LOCAL, _RELATIONS, _STATS, _TOKENS_SQL, _docs, _edges, _local, _pages, _query, _relations
from sextant.scratch import cut, drop, fresh_path
from sextant.sources import archives, discover, formats, links
from sextant.sources import records as RC

_PATH_SQL = """array_to_string(list_transform(list_filter(string_split(url_decode(regexp_replace(regexp_replace({}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*', ''), '[?#].*$', '')), '/'),
lambda x: x NOT IN ('', '.', '..')), lambda x: substr(regexp_replace(x, '[^\\p{{L}}\\p{{N}}._ ()\\-]', '_', 'g'), 1, 180)), '/')"""


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _case(key: Column, *values: Column) -> Column:
    """The value whose place the key names; the last for all others."""
    out = values[-1]
    for k in reversed(range(len(values) - 1)):
        out = F.when(key == k, values[k]).otherwise(out)
    return out


# ------------------------------------------------------------------ listings and downloads
@_query("SELECT p_name || '.' || lower(p_type) AS name, p_size AS size FROM part WHERE p_size % 2 = 0 AND ends_with(p_name, 'widget') AND p_type = 'PROMO'")
def item_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = star.read(spark, sf_dir, "part")
    listed = part.select(F.concat("p_name", F.lit("."), F.lower("p_type")).alias("name"), F.when(F.col("p_size") % 2 == 0, "original").otherwise("derivative").alias("source"), F.col("p_size").alias("size"))
    return links.item_files(listed, r"widget\.promo$").select("name", "size")


@_query("SELECT 'part' || p_partkey AS identifier, p_partkey % 10 || '/part' || p_partkey || s AS path FROM part, (VALUES ('.pdf'), ('_text.txt')) v(s)")
def search_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = star.read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("page"), F.concat(F.lit("part"), _s("p_partkey")).alias("identifier"))
    both = part.unionAll(part.filter("page % 2 = 1").withColumn("page", F.col("page") + 1))  # items that two pages list
    pages = both.groupBy("page").agg(F.to_json(F.struct(F.collect_list(F.struct("identifier")).alias("items"), F.lit("next").alias("cursor"))).alias("body"))
    return links.search_items(pages, (".pdf", "_text.txt"), r"(\d)$")


@_query("SELECT min(page_id) AS post, 'https://files.example.org/a%20' || page_id % 7 || '.pdf' AS url FROM pages GROUP BY page_id % 7")
def post_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = star.read(spark, sf_dir, "pages").select("page_id")
    html = F.concat(F.lit('<p><a href=" https://https:/files.example.org/a '), (F.col("page_id") % 7).cast("string"), F.lit('.pdf">x</a> <a href="/about">y</a></p>'))
    post = F.struct(F.col("page_id").alias("id"), F.lit("https://blog.example.org/p/").alias("link"), F.struct(html.alias("rendered")).alias("content"))
    listed = pages.groupBy(F.floor(F.col("page_id") / 10).alias("page")).agg(F.to_json(F.collect_list(post)).alias("body"))
    return links.post_links(listed).select("url", "post")


@_query(f"""WITH c AS (SELECT url, page_id AS arrival FROM pages UNION ALL SELECT upper(url), page_id + 1000000 FROM pages),
p AS (SELECT lower({_PATH_SQL.format("url")}) AS path, arrival FROM c)
SELECT path, min(arrival) AS arrival FROM p GROUP BY path""")
def first_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = star.read(spark, sf_dir, "pages").select("url", F.col("page_id").alias("arrival"))
    return links.first_captures(pages.unionAll(pages.select(F.upper("url"), F.col("arrival") + 1000000))).select("path", "arrival")


@_query("SELECT page_id, url || '&x=1%20y' AS href FROM pages")
def clean_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.lit(" https://"), F.replace("url", F.lit("://"), F.lit(":/")), F.lit("&amp;x=1 y "))
    return star.read(spark, sf_dir, "pages").select("page_id", links.clean_href(broken).alias("href"))


@_query("""WITH r AS (SELECT event_type AS host, event_id AS seq, user_id % 3 = 0 AS refused, CASE WHEN event_id % 5 = 0 THEN 45.0::DOUBLE ELSE 0.0::DOUBLE END AS given FROM events),
g AS (SELECT *, sum(CASE WHEN refused THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY seq) AS run FROM r),
n AS (SELECT *, count(*) FILTER (refused) OVER (PARTITION BY host, run ORDER BY seq) AS nth FROM g)
SELECT host, seq, CASE WHEN refused THEN greatest(given, least(600.0::DOUBLE, 5.0::DOUBLE * pow(2, nth - 1))) ELSE 0.0::DOUBLE END AS wait FROM n""")
def request_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star.read(spark, sf_dir, "events")
    status = F.when(F.col("user_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, 429).otherwise(503)).otherwise(200)
    return links.waits(e.select(F.col("event_type").alias("host"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("event_id") % 5 == 0, F.lit(45.0)).alias("retry_after")))


@_query("""SELECT 'd' || doc_id AS path, CASE doc_id % 5 WHEN 0 THEN n_chars WHEN 1 THEN n_chars // 2 WHEN 4 THEN 7 ELSE 0 END AS start,
CASE doc_id % 5 WHEN 0 THEN CASE WHEN n_chars = 0 THEN 'keep' ELSE 'keep' END WHEN 1 THEN CASE WHEN n_chars // 2 > 0 THEN 'resume' ELSE 'fetch' END WHEN 4 THEN 'resume' ELSE 'fetch' END AS action
FROM documents WHERE n_chars > 1""")
def resumed_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).filter("n_chars > 1")
    have = _case(F.col("doc_id") % 5, F.col("n_chars"), F.floor(F.col("n_chars") / 2), F.col("n_chars") + 5, F.lit(None).cast("bigint"), F.lit(7).cast("bigint"))
    size = F.when(F.col("doc_id") % 5 != 4, F.col("n_chars"))
    return links.resumed(d.select(F.concat(F.lit("d"), _s("doc_id")).alias("path"), size.alias("size"), have.alias("have")))


@_query("SELECT doc_id::VARCHAR AS path, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS ok FROM documents")
def download_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("path", _s("doc_id")).withColumn("content", F.coalesce("text", F.lit("")).cast("binary"))
    size = F.octet_length("content") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    md5 = F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.md5("content"))
    expected = d.select("path", size.alias("size"), md5.alias("md5"), F.when(F.col("doc_id") % 2 == 0, F.sha2("content", 256)).alias("sha256"))
    return links.verified(d.filter("doc_id % 11 <> 0").select("path", "content"), expected)


@_query("SELECT url FROM pages WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def ledger_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = star.read(spark, sf_dir, "pages")
    return links.ledger_pending(pages.select("url"), pages.filter("page_id % 3 = 0").select("url"))


# ------------------------------------------------------------------ discovery
_KINDS = "CASE ext WHEN 'txt' THEN 'text' WHEN 'pdf' THEN 'pdf' WHEN 'html' THEN 'html' WHEN 'zip' THEN 'zip' WHEN 'tgz' THEN 'tar' END"


@_query(f"""WITH f AS (SELECT CASE WHEN doc_id % 10 = 0 THEN '.cache/' ELSE '' END || coalesce(lang, 'xx') || '/d' || doc_id || '.' || ext AS relpath, ext, n_chars, lang, doc_id % 10 = 0 AS hid
FROM (SELECT *, ['txt', 'pdf', 'exe', 'html', 'zip', 'tgz'][doc_id % 6 + 1] AS ext FROM documents))
SELECT relpath, {_KINDS} AS kind, CASE WHEN hid THEN 'hidden' WHEN lang = 'fr' THEN 'excluded' WHEN n_chars > 3000 THEN 'too large' WHEN ext = 'exe' THEN 'unsupported: exe' END AS reason FROM f""")
def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = _case(F.col("doc_id") % 6, *[F.lit(x) for x in ("txt", "pdf", "exe", "html", "zip", "tgz")])
    path = F.concat(F.when(F.col("doc_id") % 10 == 0, ".cache/").otherwise(""), F.coalesce("lang", F.lit("xx")), F.lit("/d"), _s("doc_id"), F.lit("."), ext)
    return discover.discover(_docs(spark, sf_dir).select(path.alias("relpath"), F.col("n_chars").alias("size")), [], ["fr"], 0.003).select("relpath", "kind", "reason")


@_query("SELECT DISTINCT coalesce(lang, 'xx') || '/' || source AS folder FROM documents WHERE lang = 'de' OR (lang = 'en' AND source = 'src1')")
def pruned_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = _docs(spark, sf_dir).select(F.concat(F.coalesce("lang", F.lit("xx")), F.lit("/"), "source").alias("folder")).distinct()
    return folders.filter(discover.may_contain(F.col("folder"), ["de/**", "en/src1/*.txt"]))


_NAMES = (("a.PDF", "pdf", None), ("b.docx", "docx", None), ("c.tar.gz", None, "tar"), ("d.TXZ", None, "tar"), ("e.7z", None, "7z"), ("f.rar", None, "rar"), ("g.zip", None, "zip"), ("h.jpeg", "image", None), ("i.eml", "eml", None), ("j", None, None), ("k.exe", None, None), ("l.htm", "html", None))
_NAMES_SQL = ", ".join(f"('{n}', {f"'{a}'" if a else 'NULL'}, {f"'{b}'" if b else 'NULL'})" for n, a, b in _NAMES)


@_query(f"SELECT n_nationkey || '/' || name AS path, format, archive FROM nation, (VALUES {_NAMES_SQL}) v(name, format, archive)")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.read(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.lit([n for n, _, _ in _NAMES])).alias("name")).select(F.concat(_s("n_nationkey"), F.lit("/"), "name").alias("path"))
    return rows.select("path", discover.format_of(F.col("path")).alias("format"), discover.archive_type(F.col("path")).alias("archive"))


@_query("SELECT page_id, page_id % 2 = 0 AS is_html FROM pages")
def html_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.regexp_replace("html", "<[^>]*>", "")).cast("binary")
    return star.read(spark, sf_dir, "pages").select("page_id", discover.looks_like_html(content).alias("is_html"))


@_query("""WITH f AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem)
SELECT 's/order' || o AS base, string_agg('s/order' || o || '_' || n || '.png', ',' ORDER BY n) AS files, sum(n * 10)::BIGINT AS size, max(o + n)::BIGINT AS mtime FROM f GROUP BY o""")
def page_scan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).distinct()
    f = f.select(F.concat(F.lit("s/order"), _s("o"), F.lit("_"), _s("n"), F.lit(".png")).alias("relpath"), (F.col("n") * 10).cast("bigint").alias("size"), (F.col("o") + F.col("n")).cast("bigint").alias("mtime"))
    return discover.page_scans(f).withColumn("files", F.array_join("files", ","))


@_query("SELECT o_orderkey AS relpath FROM orders WHERE o_orderstatus = 'F'")
def vanished_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = star.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relpath"), "o_orderstatus")
    return discover.vanished(o.select("relpath"), o.filter("o_orderstatus <> 'F'").select("relpath"))


def _built(rows: DataFrame, key: str, make, schema: str) -> DataFrame:
    """A row per key that ``make(key, rows in order of n)`` gives."""
    return rows.groupBy(key).applyInPandas(lambda k, df: make(k[0], df.sort_values("n")), schema)


@_query("""SELECT 'a' || doc_id // 200 || CASE WHEN doc_id // 200 % 2 = 0 THEN '.zip' ELSE '.tar.gz' END || '!/in/' || doc_id || '.txt' AS relpath, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha1(coalesce(text, '')) AS sha1
FROM documents WHERE octet_length(encode(coalesce(text, ''))) <= 20000""")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(k: int, df: pd.DataFrame) -> pd.DataFrame:
        inside = [(f"in/{n}.{e}", (t or "").encode()) for n, t in zip(df["n"], df["text"], strict=True) for e in ("txt", "exe")]
        packed, name, kind = (samples.zipped(inside), f"a{k}.zip", "zip") if k % 2 == 0 else (samples.tarred(inside), f"a{k}.tar.gz", "tar")
        return pd.DataFrame([(name, kind, packed)], columns=["relpath", "kind", "content"])

    rows = _docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 200).alias("k"), F.col("doc_id").alias("n"), "text")
    found = archives.expand(_built(rows, "k", make, "relpath string, kind string, content binary"), ("txt",), 0.02)
    return found.select("relpath", "size", F.sha1("content").alias("sha1"))


@_query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(text)) AS k FROM conversations)
SELECT 'm' || conv_id || '#' || (k - 1) AS relpath, (k - 1)::VARCHAR AS title, md5(coalesce(text, '')) AS text FROM r""")
def mailbox_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.md5("text").alias("m")).alias("o"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("body"))
    boxes = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("o", "body")))["body"].alias("bodies"))
    pack = F.pandas_udf(lambda s: s.map(lambda x: samples.mailbox(x)), "binary")
    files = boxes.select(F.concat(F.lit("m"), _s("conv_id")).alias("relpath"), pack("bodies").alias("content"))
    read = formats.extract(archives.expand_mbox(files).select("relpath", F.lit("eml").alias("kind"), "content"))
    return read.select("relpath", "title", F.trim(F.col("pages")[0]["text"], F.lit(" \n")).alias("text"))


@_query("SELECT p_partkey AS id, p_name || p_brand AS text FROM part WHERE p_partkey % 4 = 1")
def one_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One member of each archive, read where it lies."""
    listed = archives.list_members(_part_archives(spark, sf_dir, ("zip",))).filter(F.col("member") == "1.txt")
    found = archives.read_member(listed)
    return found.select((F.regexp_extract("path", r"(\d+)\.zip$", 1).cast("bigint") * 4 + 1).alias("id"), F.col("content").cast("string").alias("text"))


#: Kind, and maker, of an archive by its ending.
_PACKED = {"zip": ("zip", samples.zipped), "tar": ("tar", lambda m: samples.tarred(m, "w")), "tar.gz": ("tar", lambda m: samples.tarred(m, "w:gz"))}


def _part_archives(spark: SparkSession, sf_dir: str, ends: tuple[str, ...] = tuple(_PACKED)) -> DataFrame:
    """``path, kind``: archives in the shared folder, a zip, a tar and a packed tar (or
    only those asked for) for every four parts."""
    root = fresh_path(spark, "archives")

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = pyarrow.fs.FileSystem.from_uri(root)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            rows = []
            for k, held in zip(batch["k"], batch["members"], strict=True):
                members = [(f"{m['n']}.txt", m["text"].encode()) for m in held]
                for end in ends:
                    kind, make = _PACKED[end]
                    with system.open_output_stream(f"{folder}/{k}.{end}", compression=None) as f:
                        f.write(make(members))
                    rows.append((f"{root}/{k}.{end}", kind))
            yield pd.DataFrame(rows, columns=["path", "kind"])

    rows = star.read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 4).alias("k"), (F.col("p_partkey") % 4).alias("n"), F.concat("p_name", "p_brand").alias("text"))
    groups = archives.dealt(rows, "k").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("members"))
    return cut(groups.mapInPandas(store, "path string, kind string"))


@_query("SELECT p_partkey AS id, kind, p_name || p_brand AS text FROM part, (VALUES ('zip'), ('tar'), ('gz')) v(kind)")
def members_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of zips, tars and packed tars, by directory, by range, and decoded."""
    found = archives.read_member(archives.list_members(_part_archives(spark, sf_dir)))
    place = F.regexp_extract("path", r"(\d+)\.[a-z.]+$", 1).cast("bigint") * 4 + F.regexp_extract("member", r"^(\d)", 1).cast("bigint")
    return found.select(place.alias("id"), F.regexp_extract("path", r"([a-z]+)$", 1).alias("kind"), F.col("content").cast("string").alias("text"))


# ------------------------------------------------------------------ formats
_LATIN = "regexp_full_match(text, '(?s)[\\x{01}-\\x{7f}\\x{a0}-\\x{ff}]*')"


@_query(f"SELECT doc_id, md5(text) AS md5 FROM documents WHERE {_LATIN}")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).filter(F.col("text").rlike("(?s)^[\x01-\x7f\xa0-\xff]*$"))
    data = _case(F.col("doc_id") % 4, F.encode("text", "UTF-8"), F.encode("text", "UTF-16"), F.encode("text", "ISO-8859-1"), F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8"))
    return d.select("doc_id", F.md5(formats.decoded_udf("iso-8859-1")(data).cast("binary")).alias("md5"))


@_query("SELECT page_id, md5('<meta charset=x>' || replace(regexp_replace(html, '[^\\x{01}-\\x{7f}\\x{a0}-\\x{ff}]', '?', 'g'), '<meta charset=\"utf-8\">', '')) AS md5 FROM pages")
def declared_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.replace(F.regexp_replace("html", "[^\x01-\x7f\xa0-\xff]", "?"), F.lit('<meta charset="utf-8">'), F.lit(""))
    latin = F.concat(F.when(F.col("page_id") % 4 == 0, '<meta charset="iso-8859-1">').otherwise('<meta http-equiv="Content-Type" content="text/html; charset=latin-1">'), body)
    data = F.when(F.col("page_id") % 2 == 0, F.encode(latin, "ISO-8859-1")).otherwise(F.encode(F.concat(F.lit('<meta charset="nonsense">'), body), "UTF-8"))
    text = formats.decoded_udf("utf-8", declared=True)(data)
    return star.read(spark, sf_dir, "pages").select("page_id", F.md5(F.regexp_replace(text, "^<meta[^>]*>", "<meta charset=x>").cast("binary")).alias("md5"))


@_query("""WITH RECURSIVE p AS (
  SELECT doc_id, 0 AS n, coalesce(text, '') AS rest, NULL::VARCHAR AS page, length(coalesce(text, '')) <= 12000 AS short FROM documents
  UNION ALL
  SELECT doc_id, n + 1, substr(rest, stop + 1), substr(rest, 1, stop), short FROM (
    SELECT *, CASE WHEN length(rest) <= 12000 THEN length(rest)
              WHEN contains(substr(rest, 6002, 5999), ' ') THEN 6001 + length(substr(rest, 6002, 5999)) - position(' ' IN reverse(substr(rest, 6002, 5999)))
              ELSE 12000 END AS stop FROM p) WHERE rest <> '' OR (n = 0 AND short)),
t AS (SELECT doc_id, n, CASE WHEN short THEN page ELSE trim(page, ' ' || chr(9) || chr(10) || chr(13)) END AS text, short FROM p WHERE n > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n)::INT AS page_no, text FROM t WHERE short OR text <> ''""")
def long_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.text_pages(_docs(spark, sf_dir), "doc_id", "text")


@_query("""WITH g AS (SELECT r_regionkey AS r, r_name, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS lines, string_agg(n_name, chr(12) ORDER BY n_nationkey) AS slides,
  string_agg(n_nationkey || chr(9) || n_name, chr(10) ORDER BY n_nationkey) AS tab FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT r || '.docx' AS relpath, lines AS text FROM g UNION ALL SELECT r || '.odt', lines FROM g UNION ALL SELECT r || '.rtf', lines FROM g UNION ALL SELECT r || '.doc', lines FROM g
UNION ALL SELECT r || '.pptx', slides FROM g UNION ALL SELECT r || '.xlsx', '[' || r_name || ']' || chr(10) || 'key' || chr(9) || 'name' || chr(10) || tab FROM g
UNION ALL SELECT r || '.csv', 'key' || chr(9) || 'name' || chr(10) || tab FROM g UNION ALL SELECT r || '.eml', lines || chr(10) FROM g UNION ALL SELECT r || '.emlx', lines || chr(10) FROM g
UNION ALL SELECT r || '.txt', lines FROM g UNION ALL SELECT r || '.png', '' FROM g""")
def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(k: int, df: pd.DataFrame) -> pd.DataFrame:
        names, title = df["n_name"].tolist(), df["r_name"].iloc[0]
        table = [["key", "name"], *([str(a), b] for a, b in zip(df["n"], names, strict=True))]
        mail = samples.eml(title, "\n".join(names))
        made = {
            "docx": samples.docx(names), "odt": samples.odt(names), "rtf": samples.rtf(names), "doc": samples.docx(names), "pptx": samples.pptx(names), "xlsx": samples.xlsx(title, table),
            "csv": "\n".join(";".join(r) for r in [*table, ["", ""]]).encode(), "eml": mail, "emlx": str(len(mail)).encode() + b"\n" + mail + b"<plist/>", "txt": "\r\n".join(names).encode(), "png": b"\x89PNG",
        }
        return pd.DataFrame([(f"{k}.{e}", data) for e, data in made.items()], columns=["relpath", "content"])

    rows = star.read(spark, sf_dir, "nation").join(star.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", F.col("n_nationkey").alias("n"), "n_name")
    files = _built(rows, "r_regionkey", make, "relpath string, content binary").withColumn("kind", discover.format_of(F.col("relpath")))
    return formats.extract(files).select("relpath", F.array_join(F.col("pages")["text"], "\f").alias("text"))


@_query("""SELECT r_regionkey || '.eml' AS relpath, r_name AS title, 'Ada Brook' AS author, '1962-02-03' AS doc_date, 'norvale.example' AS origin, 'Ada Brook>emailed>Ben Stone' AS relation,
'Ada Brook <ada@norvale.example>' AS sender FROM region""")
def mail_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = F.pandas_udf(lambda s: s.map(lambda x: samples.eml(x, "body")), "binary")
    files = star.read(spark, sf_dir, "region").select(F.concat(_s("r_regionkey"), F.lit(".eml")).alias("relpath"), F.lit("eml").alias("kind"), make("r_name").alias("content"))
    relation = F.array_join(F.transform("relations", lambda r: F.concat(r["src"]["name"], F.lit(">"), r["type"], F.lit(">"), r["dst"]["name"])), ",")
    return formats.extract(files).select("relpath", "title", "author", "doc_date", "origin", relation.alias("relation"), F.col("fields")["From"].alias("sender"))


@_query("SELECT p_partkey || '.docx' AS relpath, 'BadZipFile' AS error, 1::BIGINT AS n_pages FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey || '.pdf', 'NotImplementedError', 1 FROM part WHERE p_partkey % 2 = 1")
def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = star.read(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 2 == 0, "docx").otherwise("pdf")
    read = formats.extract(part.select(F.concat(_s("p_partkey"), F.lit("."), kind).alias("relpath"), kind.alias("kind"), F.col("p_name").cast("binary").alias("content")))
    return read.select("relpath", F.split("error", ":")[0].alias("error"), F.size("pages").cast("bigint").alias("n_pages"))


@_query("""WITH d AS (SELECT doc_id, substr(text, 1, (doc_id % 100)::INT) AS a, substr(text, 1, ((doc_id * 7) % 130)::INT) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(a) < 50 THEN CASE WHEN b <> '' THEN b ELSE a END WHEN length(b) > length(a) * 1.3 THEN a || chr(10) || b ELSE a END AS text, (length(a) < 50 AND b <> '')::INT AS ocr FROM d""")
def ocr_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).filter("text is not null")
    layer, found = F.substring("text", F.lit(1), (F.col("doc_id") % 100).cast("int")), F.substring("text", F.lit(1), ((F.col("doc_id") * 7) % 130).cast("int"))
    return d.select("doc_id", formats.merge_ocr(layer, found).alias("m")).select("doc_id", "m.text", "m.ocr")


@_query("""WITH p AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS n FROM lineitem)
SELECT d AS doc_id, n AS page_no, CASE WHEN n % 2 = 0 AND (d + n) % 3 <> 0 THEN 'read ' || d WHEN n % 2 = 0 THEN '' ELSE 'layer' END AS text, n % 2 = 0 AND (d + n) % 3 = 0 AS missing FROM p""")
def ocr_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = star.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no")).distinct()
    job = F.col("page_no") % 2 == 0
    pages = p.select("doc_id", "page_no", F.when(job, "").otherwise("layer").alias("text"), job.alias("job"))
    cache = p.filter("(doc_id + page_no) % 3 <> 0").select("doc_id", "page_no", F.concat(F.lit("read "), _s("doc_id")).alias("ocr_text"))
    return formats.apply_ocr(pages, cache).select("doc_id", "page_no", "text", "missing")


@_query("""WITH d AS (SELECT doc_id, text, (length(text) // 3)::INT AS t FROM documents WHERE length(text) >= 9)
SELECT doc_id, 1 AS page_no, substr(text, 1, t) AS text FROM d UNION ALL SELECT doc_id, 2, substr(text, t + 1, t) FROM d UNION ALL SELECT doc_id, 3, substr(text, 2 * t + 1) FROM d""")
def sidecar_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).filter(F.length("text") >= 9)
    third = F.floor(F.length("text") / 3).cast("int")
    blobs = d.select("doc_id", F.col("text").alias("blob"), F.array(F.lit(0), third, third * 2).alias("offsets"))
    pages = d.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page_no"), F.lit("short").alias("text"))
    return formats.sidecar_pages(pages, blobs).select("doc_id", "page_no", "text")


# ------------------------------------------------------------------ records
@_query("SELECT s_suppkey::VARCHAR AS key, s_name || ' \"the\"; Ltd' AS name, s_nationkey::VARCHAR AS nation FROM supplier")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star.read(spark, sf_dir, "supplier")
    line = F.concat(_s("s_suppkey"), F.lit(';"'), "s_name", F.lit(' ""the""; Ltd";'), _s("s_nationkey"))
    return RC.csv_lines(s.select(line.alias("line")), ["key", "name", "nation"], ";")


@_query("SELECT 'p#' || p_partkey AS relpath, p_name || ' (' || p_brand || '): ' AS title, p_name || chr(10) || p_type AS text FROM part")
def record_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.read(spark, sf_dir, "part").select(_s("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.lit(None).cast("string").alias("none"))
    return RC.row_documents(rows, RC.RecordConfig("p", "key", ("name", "none", "type"), title="{name} ({brand}): {none}"), "p").select("relpath", "title", "text")


@_query("SELECT 'd' || n_regionkey AS relpath, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_no, n_nationkey::VARCHAR AS key, n_name || '''s \"x\", (y); &' AS name, NULL::VARCHAR AS note FROM nation")
def dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = star.read(spark, sf_dir, "nation")
    values = F.concat(F.lit("("), _s("n_nationkey"), F.lit(", '"), "n_name", F.lit("\\'s \"x\", (y); &amp;amp;', NULL)"))
    dumps = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n_nationkey", values.alias("v"))))["v"], ", ").alias("v"))
    text = F.concat(F.lit("CREATE TABLE x (a int);\nINSERT INTO other (a) VALUES (1);\nINSERT INTO `x` (`key`, name, note) VALUES "), "v", F.lit(";\n"))
    rows = RC.sql_rows(dumps.select(F.concat(F.lit("d"), _s("n_regionkey")).alias("relpath"), text.alias("text")), "x", unescape=True)
    return rows.select("relpath", "row_no", *[F.col("values")[c].alias(c) for c in ("key", "name", "note")])


@_query("""SELECT 'c' || conv_id AS relpath, strftime(TIMESTAMP '2020-01-01' + to_minutes(turn::BIGINT) + to_hours(CASE WHEN turn % 2 = 0 THEN 0 ELSE 9 END), '%Y-%m-%d %H:%M:%S') AS ts,
coalesce(role, '') AS sender, text FROM conversations WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''""")
def chat_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star.read(spark, sf_dir, "conversations")
    epoch = (F.lit(1577836800) + F.col("turn") * 60).cast("string")
    local = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.col("turn") * 60 + 9 * 3600), "yyyy-MM-dd'T'HH:mm:ss'+05:00'")
    even = F.to_json(F.struct(epoch.alias("ts"), F.col("role").alias("from"), F.col("text").alias("body")))
    odd = F.to_json(F.struct(local.alias("date"), F.struct(F.col("role").alias("real_name")).alias("user_profile"), F.array(F.col("text")).alias("text")))
    line = F.when(F.col("turn") % 2 == 0, even).otherwise(odd)
    files = c.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))["l"], "\n{broken\n").alias("text"))
    rows = RC.chat_messages(files.select(F.concat(F.lit("c"), _s("conv_id")).alias("relpath"), "text"))
    return rows.select("relpath", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "sender", "text")


_REGISTRY = """nodes AS (SELECT 's' || s_suppkey AS id, s_name AS name, 'Offshore entity' AS label, 'company' AS type FROM supplier
  UNION ALL SELECT 'c' || c_custkey, c_name || CASE WHEN c_custkey % 10 = 0 THEN ' Ltd' ELSE '' END, 'Officer', CASE WHEN c_custkey % 10 = 0 THEN 'company' ELSE 'person' END FROM customer),
e AS (SELECT 'c' || o_custkey AS a, 's' || l_suppkey AS b, strftime(min(o_orderdate), '%Y-%m-%d') AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 40 = 0 GROUP BY ALL),
w AS (SELECT a AS id, 0 AS way, b AS other, d FROM e UNION ALL SELECT b, 1, a, d FROM e)"""


@_query(f"""WITH {_REGISTRY}, l AS (SELECT w.id, string_agg(CASE WHEN way = 0 THEN '- client of → ' || n.name ELSE '- ← client of: ' || n.name END || ' (' || lower(n.label) || ') [' || d || ' –]', chr(10) ORDER BY way, other) AS lines
  FROM w JOIN nodes n ON n.id = w.other GROUP BY w.id)
SELECT 'registry#node-' || nodes.id AS relpath, type, name || chr(10) || 'Type: ' || label || chr(10) || 'Source: src' || coalesce(chr(10) || chr(10) || 'Connections:' || chr(10) || lines, '') AS text FROM nodes LEFT JOIN l USING (id)""")
def registry_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, o, line = (star.read(spark, sf_dir, t) for t in ("supplier", "customer", "orders", "lineitem"))
    company = RC.registry_nodes(s.select(F.concat(F.lit("s"), _s("s_suppkey")).alias("node_id"), F.col("s_name").alias("name"), F.lit("src").alias("sourceID")), "Offshore entity", "company", ["SRC"])
    named = F.concat("c_name", F.when(F.col("c_custkey") % 10 == 0, " Ltd").otherwise(""))
    people = RC.registry_nodes(c.select(F.concat(F.lit("c"), _s("c_custkey")).alias("node_id"), named.alias("name"), F.lit("src").alias("sourceID")), "Officer", "person")
    nodes = company.unionByName(people)
    found = o.filter("o_orderkey % 40 = 0").join(line, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.concat(F.lit("c"), _s("o_custkey")).alias("node_id_start"), F.concat(F.lit("s"), _s("l_suppkey")).alias("node_id_end"))
    rows = found.agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("start_date")).withColumn("rel_type", F.lit("CLIENT_OF")).withColumn("end_date", F.lit(None).cast("string"))
    rows = rows.unionByName(rows.withColumn("node_id_end", F.lit("nowhere")))  # ends that do not exist
    return RC.registry_documents(nodes, RC.registry_edges(rows, nodes)).select("relpath", "type", "text")


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 3 THEN 'person' ELSE 'identifier' END AS type, CASE c_custkey % 4 WHEN 0 THEN 'user' || c_custkey || '@x.org' WHEN 1 THEN '+49' || c_custkey WHEN 2 THEN 'nick' || c_custkey ELSE 'Ada Brook' END AS name FROM customer")
def chat_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _s("c_custkey")
    shown = _case(F.col("c_custkey") % 4, F.concat(F.lit("User"), k, F.lit("@X.org")), F.concat(F.lit("+49"), k), F.concat(F.lit("nick"), k), F.lit("Brook, Ada"))
    return star.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), RC.participant(shown).alias("p")).select("id", "p.type", "p.name")


# ------------------------------------------------------------------ dates
_ORDERED = "(SELECT o_orderkey AS k, o_orderdate AS d, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders)"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"))


def _as(pattern: str) -> Column:
    return F.date_format("d", pattern)


@_query(f"SELECT k, CASE WHEN k % 10 = 9 THEN '' WHEN k % 10 = 8 THEN CASE WHEN year(d) < 2000 THEN iso ELSE '19' || substr(iso, 3) END WHEN k % 10 = 7 THEN substr(iso, 1, 4) ELSE iso END AS date FROM {_ORDERED}")
def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = [_as("yyyy-MM-dd HH:mm"), _as("yyyy/M/d"), _as("M/d/yyyy H:mm"), _as("d MMM yyyy"), _as("MMMM d, yyyy"), _as("d.M.yyyy"), _as("yyyyMMdd"), F.concat(F.lit("in "), _as("yyyy")), _as("d-MMM-yy"), F.lit("unknown")]
    return _dated(spark, sf_dir).select("k", DT.parse(_case(F.col("k") % 10, *forms)).alias("date"))


@_query(f"SELECT k, CASE WHEN k % 4 = 3 THEN '' ELSE iso END AS date FROM {_ORDERED}")
def dates_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [F.concat(F.lit("a/b/"), _as("yyyy-MM-dd"), F.lit(" x.txt")), F.concat(F.lit("a/x "), _as("d MMM yyyy"), F.lit(".txt")), F.concat(F.lit("x_"), _as("yyyyMMdd"), F.lit("_y.pdf")), F.concat(F.lit("note "), (F.col("k") % 10).cast("string"), F.lit(".txt"))]
    return _dated(spark, sf_dir).select("k", DT.from_filename(_case(F.col("k") % 4, *names), 1900, 2100).alias("date"))


@_query(f"""SELECT k, CASE WHEN k % 3 = 2 THEN '' ELSE iso END AS in_text, CASE WHEN year(d) < 2000 THEN iso ELSE '19' || substr(iso, 3) END AS military, (year(d) - 25)::VARCHAR AS declassify, iso AS run, year(d)::INT AS year FROM {_ORDERED}""")
def dates_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [F.concat(F.lit("Seen "), _as("MMMM d, yyyy"), F.lit(" there")), F.concat(F.lit("On "), _as("d MMMM yyyy"), F.lit(", then March 3, 1950")), F.lit("On 41 May 1999 and 1 May 3999")]
    return _dated(spark, sf_dir).select(
        "k", DT.from_text(_case(F.col("k") % 3, *texts), 1900, 2100).alias("in_text"), DT.military(F.concat(F.lit("CABLE "), F.upper(_as("dd MMM yy"))), 1900, 2100).alias("military"),
        DT.declassify_year(F.concat(F.lit("Declassify On: "), _as("yyyyMMdd"))).alias("declassify"), DT.run_date(F.concat(F.lit("Run Date: "), _as("M/d/yyyy")), 1900, 2100).alias("run"), DT.year_of(_as("yyyy-MM-dd")).alias("year"),
    )


@_query(f"SELECT k, iso AS mail_day, iso || ' 23:30:00' AS clock, iso || ' 00:00:00' AS epoch FROM {_ORDERED}")
def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    epoch = F.unix_timestamp("d") * F.when(F.col("k") % 2 == 0, 1000).otherwise(1)
    return _dated(spark, sf_dir).select(
        "k", DT.rfc822(F.concat(F.lit("Fri, "), _as("dd MMM yyyy"), F.lit(" 23:30:00 -0500"))).alias("mail_day"), show(DT.wall_clock(F.concat(_as("yyyy-MM-dd"), F.lit("T23:30:00-05:00")))).alias("clock"), show(DT.wall_clock(epoch.cast("string"))).alias("epoch"),
    )


# ------------------------------------------------------------------ metadata
@_query("""SELECT doc_id, source || '/' || 1990 + doc_id % 10 || '-0' || 1 + doc_id % 9 || '-1' || doc_id % 10 || ' note_' || doc_id || '.txt' AS relpath, 1990 + doc_id % 10 || ' 0' || 1 + doc_id % 9 || ' 1' || doc_id % 10 || ' note ' || doc_id AS title,
source AS collection, 1990 + doc_id % 10 || '-0' || 1 + doc_id % 9 || '-1' || doc_id % 10 AS doc_date, (1990 + doc_id % 10)::INT AS year, 2::INT AS pages, 1::INT AS ocr_pages,
CASE doc_id % 4 WHEN 0 THEN 'Top private' WHEN 1 THEN 'Private' ELSE '' END AS classification, CASE WHEN doc_id % 5 = 0 THEN 'Harbour Board' ELSE '' END AS origin,
CASE WHEN doc_id % 3 = 0 THEN 'a.txt, b.txt' END AS attachments, (length(coalesce(text, '')) + CASE doc_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 8 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 14 ELSE 0 END + 7)::BIGINT AS chars FROM documents""")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    text = F.concat(_case(k % 4, F.lit("TOP PRIVATE\n"), F.lit("PRIVATE\n"), F.lit("")), F.when(k % 5 == 0, "Harbour Board\n").otherwise(""), F.coalesce("text", F.lit("")))
    path = F.concat("source", F.lit("/"), _s("year"), F.lit("-0"), (1 + k % 9).cast("string"), F.lit("-1"), (k % 10).cast("string"), F.lit(" note_"), k.cast("string"), F.lit(".txt"))
    page = lambda n, t, ocr: F.struct(F.lit(n).alias("n"), t.alias("text"), F.lit(ocr).alias("ocr"))
    docs = _docs(spark, sf_dir).withColumn("year", 1990 + k % 10).select(
        "doc_id", path.alias("relpath"), F.lit("text").alias("kind"), F.array(page(1, text, 0), page(2, F.lit("second"), 1)).alias("pages"), none.alias("title"), none.alias("author"), none.alias("doc_date"), none.alias("origin"),
        none.alias("classification"), none.alias("member"), none.alias("collection"), F.create_map(F.lit("k"), F.lit("v")).alias("fields"), F.when(k % 3 == 0, F.array(F.lit("a.txt"), F.lit("b.txt"))).alias("attachments"),
    )
    out = MD.document_metadata(docs, merge(["base"], demo.PACKS), CF.from_dict("x", {}).data)
    number = F.regexp_extract("relpath", r"note_(\d+)", 1).cast("bigint")
    return out.select(number.alias("doc_id"), "relpath", "title", "collection", "doc_date", "year", "pages", "ocr_pages", "classification", "origin", F.col("fields")["Attachments"].alias("attachments"), "chars")


@_query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Report on ' || p_name WHEN 1 THEN 'x ' || p_name WHEN 2 THEN p_name || ' page' WHEN 3 THEN 'Zipped ' || p_name ELSE 'About ' || p_name END AS title,
CASE WHEN p_partkey % 2 = 0 THEN 'Press' WHEN p_partkey % 3 = 0 THEN 'Board' ELSE '' END AS publisher, 'Desk ' || p_partkey || ' — Quay' AS author, substr('Summary of ' || p_name || ' ' || repeat('word ', 200), 1, 600) AS summary,
'body ' || p_name AS stripped FROM part""")
def derived_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, none = F.col("p_partkey"), F.col("p_name"), F.lit(None).cast("string")
    embedded = _case(k % 5, none, F.lit("untitled"), F.lit("Slide 3"), F.lit("document12"), F.concat(F.lit("<b>Microsoft Word - </b>About "), name))
    title = MD.title(F.when(k % 5 == 0, F.concat(F.lit("Report on "), name)), embedded, F.when(k % 5 == 2, "html").otherwise("pdf"), F.concat(F.lit(" "), name, F.lit("\n page ")), F.when(k % 5 == 3, F.concat(F.lit("in/Zipped_"), name, F.lit(".txt"))), F.concat(F.lit("d/x-"), name, F.lit(".pdf")))
    path = F.concat(F.when(k % 2 == 0, "press/").otherwise(""), F.when(k % 3 == 0, "board/").otherwise(""), name)
    head = F.concat(F.lit("FROM:  Desk "), k.cast("string"), F.lit("\n Quay\n"))
    pages = F.array(F.struct(F.concat(F.lit("Summary  of\n"), name).alias("text")), F.struct(F.repeat(F.lit("word \n"), 200).alias("text")), F.struct(F.lit("third").alias("text")))
    body = F.concat(F.lit("PAGE 12\nbody "), name)
    return star.read(spark, sf_dir, "part").select(
        k.alias("id"), title.alias("title"), MD.publisher(path, [("^press/", "Press"), ("board", "Board")]).alias("publisher"), MD.author_line(head).alias("author"), MD.summary(pages).alias("summary"),
        TX.normalise_space(MD.strip_boilerplate(body, [r"(?m)^PAGE \d+$"])).alias("stripped"),
    )


@_query("""WITH t AS (SELECT c_custkey AS k, c_name AS n, 12000 + 1 + c_custkey % 900 AS m FROM customer),
p AS (SELECT k, unnest([n, repeat('x', 12000), repeat('x', (m - 12000)::INT) || chr(10) || chr(10) || n, n || ' a' || chr(10) || ' ' || chr(10) || 'b', repeat('y', 7000), repeat('z', 5500), 'end']) AS text, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) AS page_no FROM t)
SELECT k, page_no::INT AS page_no, md5(text) AS md5 FROM p""")
def paragraph_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short paragraph before a long one, gaps, form feeds, and a cut at a space."""
    n, m = F.col("c_name"), (12001 + F.col("c_custkey") % 900).cast("int")
    text = F.concat(n, F.lit("\n\n"), F.repeat(F.lit("x"), m), F.lit("\n\n"), n, F.lit("\f\n\n"), n, F.lit(" a\n \nb\f"), F.repeat(F.lit("y"), F.lit(7000)), F.lit(" "), F.repeat(F.lit("z"), F.lit(5500)), F.lit("\n\n"), F.lit("\fend"))
    pages = formats.text_pages(star.read(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")
    return pages.select(F.col("doc_id").alias("k"), "page_no", F.md5(F.col("text").cast("binary")).alias("md5"))


@_query("SELECT o_orderkey AS id, o_orderpriority AS subject, 'Embassy Norvale' AS origin, 'Relations,Norvale' AS named, o_orderstatus AS agency, '19' || o_orderkey % 90 + 10 AS published FROM orders")
def parsed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cable = F.concat(F.lit("FM AMEMBASSY NORVALE\nTAGS: PREL, NV\nSUBJECT: "), "o_orderpriority", F.lit("\n\nBody"))
    parsed = MD.cable_header(cable, {"PREL": "Relations"}, {"NV": "Norvale"}, {})
    form = MD.header_fields(F.concat(F.lit("AGENCY : "), "o_orderstatus", F.lit("\nRECORD NUMBER : 1\nAGENCY : again\n")), ("AGENCY", "RECORD NUMBER"))
    rows = star.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), parsed.alias("c"), form.alias("f"), DT.from_filename(F.concat(F.lit("x/19"), (F.col("o_orderkey") % 90 + 10).cast("string"), F.lit("0102.pdf")), 1900, 2099).alias("p"))
    named = F.array_join(F.transform("c.entities", lambda e: F.element_at(F.split(e["name"], " — "), -1)), ",")
    return rows.select("id", F.col("c.subject").alias("subject"), F.col("c.origin").alias("origin"), named.alias("named"), F.col("f")["AGENCY"].alias("agency"), F.substring("p", 1, 4).alias("published"))


# ------------------------------------------------------------------ names and identifiers
_REGION_SQL = "(SELECT n_nationkey AS k, upper(substr(r_name, 1, 1)) || lower(substr(split_part(r_name, ' ', 1), 2)) AS s FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = star.read(spark, sf_dir, "nation").join(star.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_nationkey").alias("k"), F.initcap(F.split("r_name", " ")[0]).alias("s"))


@_query(f"SELECT k, CASE WHEN k % 6 < 4 THEN 'Anna ' || s END AS person, CASE WHEN k % 2 = 0 THEN 'Anna ' || s END AS shown, CASE WHEN k % 3 = 0 THEN s || ' Mills' END AS org, k % 2 = 0 AS company, 'anna ' || lower(s) AS plain, 'person:anna ' || lower(s) AS gkey, 'O''Neill ' || s AS title FROM {_REGION_SQL}")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("k"), F.col("s")
    spans = _case(k % 6, F.concat(F.lit("Dr. Anna Q. "), s, F.lit("’s")), F.concat(F.lit("Anna "), F.upper(s)), F.concat(F.lit("Mrs Anna "), s), F.concat(F.lit("Anna  "), s), F.lower(F.concat(F.lit("anna "), s)), F.concat(F.lit("The "), s, F.lit(" Report")))
    shown = F.when(k % 2 == 0, F.concat(s, F.lit(", Anna (Legal) via list"))).otherwise(F.concat(s, F.lit("@x.org")))
    orgs = _case(k % 3, F.concat(F.lit("the "), s, F.lit(" Mills's")), F.lower(s), F.lit("committee"))
    return _surnames(spark, sf_dir).select(
        "k", NM.person_udf()(spans).alias("person"), NM.display_udf()(shown).alias("shown"), NM.org_udf()(orgs).alias("org"), NM.looks_like_company(F.concat(s, F.when(k % 2 == 0, " Shipping Ltd.").otherwise(" Ltd Shipping"))).alias("company"),
        FO.plain(F.concat(F.lit("Änna "), s)).alias("plain"), FO.gkey(F.lit("person"), F.concat(F.lit("ÁNNA   "), s)).alias("gkey"), FO.title(F.concat(F.lit("o'NEILL "), F.upper(s))).alias("title"),
    )


_SURNAME_SQL = "'Z' || translate(lower(substr(md5(s_name), 1, 8)), '0123456789', 'ghijklmnop')"


@_query(f"""WITH t AS (SELECT s_suppkey AS k, s_suppkey % 8 AS c, {_SURNAME_SQL} AS s FROM supplier)
SELECT k, CASE c WHEN 0 THEN 'Al ' || s WHEN 1 THEN 'Van ' || s WHEN 2 THEN 'Bin ' || s WHEN 3 THEN 'Maria de la ' || s WHEN 5 THEN 'Abu ' || s || ' Hassan Omar' WHEN 6 THEN 'Ann ' || s END AS person,
CASE WHEN c < 3 THEN 'Al ' || s WHEN c < 6 THEN s || ' al Amin' END AS shown FROM t""")
def particle_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose first word is also a particle, and rows of particles that are none."""
    k = F.col("s_suppkey")
    s = F.concat(F.lit("Z"), F.translate(F.lower(F.substring(F.md5(F.col("s_name").cast("binary")), 1, 8)), "0123456789", "ghijklmnop"))
    join = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    spans = _case(k % 8, join("Al ", s), join("Van ", s), join("Bin ", s), join("Maria de la ", s), join("Maria De La ", s), join("Abu ", s, " Hassan Omar"), join("Dr. Ann Q. ", s, "'s"), join("van der ", s))
    shown = F.when(k % 8 < 3, join(s, ", Al")).when(k % 8 < 6, join(s, " al Amin (Legal)")).otherwise(join("al, ", s))
    return star.read(spark, sf_dir, "supplier").select(k.alias("k"), NM.person_udf()(spans).alias("person"), NM.display_udf()(shown).alias("shown"))


@_query("""WITH c AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 18, '0') AS b FROM customer), v AS (SELECT k, b, 98 - ((b || '131400')::HUGEINT % 97)::INT AS digits FROM c)
SELECT k, 'DE' || lpad(digits::VARCHAR, 2, '0') || b AS iban FROM v WHERE k % 2 = 0""")
def ibans_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lpad(_s("c_custkey"), 18, "0").alias("b"))
    check = F.lit(98) - (F.concat("b", F.lit("131400")).cast("decimal(24,0)") % 97).cast("int") + F.when(F.col("k") % 2 == 0, 0).otherwise(1)
    spaced = F.concat(F.lit("DE"), F.lpad(check.cast("string"), 2, "0"), F.lit(" "), F.regexp_replace("b", "(.{4})", "$1 "))
    return c.select("k", F.explode(TX.ibans(F.concat(F.lit("Pay to "), F.trim(spaced), F.lit(", please")))).alias("iban"))


@_query("SELECT doc_id, md5(regexp_replace(text, '(?i)\\b(the|of)', '<mark>\\1</mark>', 'g')) AS md5 FROM documents WHERE regexp_full_match(text, '(?s)[\\x{01}-\\x{7f}]*')")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter(F.col("text").rlike("(?s)^[\x01-\x7f]*$")).select("doc_id", F.md5(TX.highlight(F.col("text"), "the AND of").cast("binary")).alias("md5"))


@_query("""SELECT doc_id, trim(regexp_replace(substr(text, 1, 300), '[ \\t\\n\\r]+', ' ', 'g')) AS one_line, upper(lang) = lang AS upper, n_chars > 5 AS wide, 'x/y.tar' AS stem, array_to_string(list_sort(list_distinct(string_split(source || ',b,' || source, ','))), '|') AS parts,
length(regexp_replace(coalesce(lang, ''), '[aeiou]', '', 'g'))::INT AS consonants, least(doc_id, n_chars) AS low, greatest(doc_id, n_chars) AS high FROM documents WHERE regexp_full_match(text, '(?s)[\\x{01}-\\x{7f}\\x{a1}-\\x{ff}]*')""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).filter(F.col("text").rlike("(?s)^[\x01-\x7f\xa1-\xff]*$"))
    parts = F.array_join(F.array_sort(F.array_distinct(F.split(F.concat("source", F.lit(",b,"), "source"), ","))), "|")
    return d.select(
        "doc_id", TX.normalise_space(F.substring("text", 1, 300)).alias("one_line"), (F.upper("lang") == F.col("lang")).alias("upper"), (F.col("n_chars") > 5).alias("wide"), TX.without_extension(F.lit("x/y.tar.gz")).alias("stem"), parts.alias("parts"),
        F.length(F.regexp_replace(F.coalesce("lang", F.lit("")), "[aeiou]", "")).alias("consonants"), F.least("doc_id", "n_chars").alias("low"), F.greatest("doc_id", "n_chars").alias("high"),
    )


@_query("""SELECT p_partkey AS id, p_name AS base, CASE WHEN p_type = 'PROMO' THEN 'sale' ELSE p_type END AS mapped, CASE WHEN p_partkey < 1000 THEN p_partkey::VARCHAR ELSE (p_partkey // 1000)::VARCHAR || ',' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') END AS shown,
'a&<>"''b' AS unescaped, levenshtein(p_name, 'cold widget')::INT AS edits, '{"name":"' || p_name || '"}' AS json, sha1(p_name) AS sha1 FROM part WHERE p_partkey < 1000000""")
def scalar_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.read(spark, sf_dir, "part").filter("p_partkey < 1000000").select(
        F.col("p_partkey").alias("id"), TX.without_extension(TX.basename(F.concat(F.lit("a/b/"), "p_name", F.lit(".tar")))).alias("base"), TX.map_get({"PROMO": "sale"}, F.col("p_type")).alias("mapped"), TX.thousands(F.col("p_partkey")).alias("shown"),
        TX.unescape_html(F.lit("a&amp;&lt;&gt;&quot;&#39;b")).alias("unescaped"), F.levenshtein("p_name", F.lit("cold widget")).alias("edits"), F.to_json(F.struct(F.col("p_name").alias("name"))).alias("json"), F.sha1(F.col("p_name").cast("binary")).alias("sha1"),
    )


# ------------------------------------------------------------------ dictionary, codenames, candidates
_SINGLES, _PAIRS = ("with", "this", "und", "pour"), (("of", "the"), ("in", "an"))
_HIT_SQL = " UNION ALL ".join(
    [f"SELECT doc_id, 'w:{w}' AS key, len(list_filter(t, lambda x: x = '{w}' OR x = '{w.capitalize()}' OR (caps AND x = '{w.upper()}'))) AS count FROM k" for w in _SINGLES]
    + [f"SELECT doc_id, 'p:{a} {b}', len(list_filter(range(1, len(t)), lambda i: lower(t[i]) = '{a}' AND lower(t[i + 1]) = '{b}')) FROM k" for a, b in _PAIRS]
)


@_query(f"""WITH k AS (SELECT doc_id, list_transform({_TOKENS_SQL}, lambda x: CASE WHEN ends_with(x, '''s') AND length(x) > 3 THEN substr(x, 1, length(x) - 2) ELSE x END) AS t,
length(regexp_replace(substr(text, 1, 20000), '[^\\p{{L}}]', '', 'g')) >= 40 AND length(regexp_replace(substr(text, 1, 20000), '[^\\p{{Lu}}]', '', 'g')) >= length(regexp_replace(substr(text, 1, 20000), '[^\\p{{L}}]', '', 'g')) * 0.85 AS caps FROM documents WHERE text IS NOT NULL)
SELECT doc_id, key, count::INT AS count FROM ({_HIT_SQL}) WHERE count > 0""")
def alias_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f"w:{w}", "technology", [w]) for w in _SINGLES] + [(f"p:{a} {b}", "organization", [f"{a} {b}"]) for a, b in _PAIRS]
    table = spark.createDataFrame([(*r, 0, k) for k, r in enumerate(rows)], "key string, type string, aliases array<string>, pack_ord int, ord int")
    return MA.match_pages(_pages(spark, sf_dir), MA.alias_table(table)).select("doc_id", "key", "count")


@_query("""WITH a AS (SELECT p_partkey AS ord, p_size % 3 AS pack, unnest([p_name, p_brand, upper(p_type)]) AS alias, unnest([0, 1, 2]) AS place FROM part),
i AS (SELECT *, CASE WHEN NOT contains(alias, ' ') OR alias = upper(alias) OR regexp_matches(alias, '[0-9]') THEN alias ELSE lower(alias) END AS identity FROM a)
SELECT alias, 'part:' || ord AS key FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY pack, ord, place) AS k FROM i) WHERE k = 1""")
def alias_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = star.read(spark, sf_dir, "part")
    table = part.select(F.concat(F.lit("part:"), _s("p_partkey")).alias("key"), F.lit("technology").alias("type"), F.array("p_name", "p_brand", F.upper("p_type")).alias("aliases"), (F.col("p_size") % 3).alias("pack_ord"), F.col("p_partkey").alias("ord"))
    return MA.alias_table(table).select("alias", "key")


@_query(f"""WITH {_CAPS}, m AS (SELECT unnest(['THERE', 'ATION', 'ENTION']) AS m), t AS (SELECT token, length(token) AS l FROM stats)
SELECT DISTINCT token FROM t, m WHERE levenshtein(token, m) <= CASE WHEN length(m) < 6 THEN 1 ELSE 2 END""")
def near_markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = CN.token_stats(_pages(spark, sf_dir)).withColumn("text_docs", F.lit(0))
    return CN.near_marking(stats, spark.createDataFrame([("THERE",), ("ATION",), ("ENTION",)], "m string"))


@_query("""WITH p AS (SELECT doc_id, text, length(regexp_replace(substr(text, 1, 20000), '[^\\p{L}]', '', 'g')) AS l, length(regexp_replace(substr(text, 1, 20000), '[^\\p{Lu}]', '', 'g')) AS u FROM (SELECT doc_id, upper(text) AS text FROM documents)),
w AS (SELECT unnest(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{5,}'))) AS w FROM p WHERE l >= 40 AND u >= l * 0.85)
SELECT w AS token, count(*) AS known_n FROM w WHERE w IN ('LICENSE', 'RIGHTS', 'RESERVED', 'COPYRIGHT', 'TIONS', 'ATION') GROUP BY w""")
def known_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).withColumn("text", F.upper("text"))
    return CN.known_counts(pages, spark.createDataFrame([(w,) for w in ("LICENSE", "RIGHTS", "RESERVED", "COPYRIGHT", "TIONS", "ATION")], "token string"))


@_query("SELECT a.r_name || b.r_name AS word, NOT contains(a.r_name || b.r_name, ' ') AS ok FROM region a, region b UNION ALL SELECT r_name, false FROM region")
def run_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = star.read(spark, sf_dir, "region").select("r_name")
    words = r.select(F.explode(F.array(*[F.concat("r_name", F.lit(x)) for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "")])).alias("word"))
    return words.select("word", CN.segments_udf(frozenset(("AFRICA", "AMERICA", "ASIA", "EUROPE")))(F.col("word")).alias("ok"))


@_query("""WITH s AS (SELECT upper(p_name) AS n, count(DISTINCT p_size) AS docs FROM part GROUP BY 1), v AS (SELECT string_split(upper(p_name), ' ')[-1] AS token FROM part WHERE contains(p_name, ' ') GROUP BY 1 HAVING count(DISTINCT p_size) >= 2),
t AS (SELECT DISTINCT unnest(string_split(upper(p_name), ' ')) AS token FROM part)
SELECT 'program:' || token AS key, token AS name, 1::INT AS auto FROM t WHERE token NOT IN (SELECT token FROM v)""")
def vetoed_codenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = star.read(spark, sf_dir, "part")
    tokens = part.select(F.explode(F.split(F.upper("p_name"), " ")).alias("token")).distinct()
    return CN.as_entities(CN.surname_veto(tokens, part.select(F.col("p_size").alias("doc_id"), F.col("p_name").alias("name")))).select("key", "name", "auto")


@_query("""WITH c AS (SELECT 'person:' || CASE WHEN l_suppkey % 2 = 0 THEN 'Ann' ELSE 'Zed' END || ' S' || l_suppkey AS key, count(DISTINCT l_orderkey) AS docs, min((l_orderkey % 50 < l_suppkey % 7)::INT) AS ocr FROM lineitem WHERE l_orderkey % 25 = 0 GROUP BY 1)
SELECT key FROM c WHERE docs >= 3 AND (ocr = 0 OR starts_with(key, 'person:Ann'))""")
def retained_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = star.read(spark, sf_dir, "lineitem").filter("l_orderkey % 25 = 0")
    key = F.concat(F.lit("person:"), F.when(F.col("l_suppkey") % 2 == 0, "Ann").otherwise("Zed"), F.lit(" S"), _s("l_suppkey"))
    uid = F.concat_ws("/", _s("l_orderkey"), _s("l_linenumber"), _s("l_suppkey"))
    rows = line.select(key.alias("key"), F.col("l_orderkey").alias("doc_id"), uid.alias("page_no"), (F.col("l_orderkey") % 50 < F.col("l_suppkey") % 7).cast("int").alias("ocr"))
    raw = rows.select("key", "doc_id", "page_no", F.lit(1).alias("count"), F.lit(2).alias("src"))
    support = M.candidate_support(raw, rows.select("doc_id", "page_no", "ocr").distinct())
    return M.retained_candidates(support, 3, spark.createDataFrame([("Ann",)], "name string"))


@_query(f"""WITH {_STATS}, w AS (SELECT DISTINCT doc_id, (page_no - 1) // 5 AS win, entity_id AS e FROM ment), ok AS (SELECT doc_id, win FROM w GROUP BY ALL HAVING count(*) BETWEEN 2 AND 3)
SELECT DISTINCT a.doc_id, a.e AS src, b.e AS dst FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.win = b.win AND a.e < b.e JOIN ok ON ok.doc_id = a.doc_id AND ok.win = a.win""")
def hub_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pairs(E.window_entities(star.mentions(spark, sf_dir), 5, 3))


@_query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'person:explicit' WHEN 1 THEN 'company:Tarn Mills' WHEN 2 THEN 'person:Ada Brook' ELSE 'person:' || c_name END AS key FROM customer""")
def resolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    refs = star.read(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 4 == 1, "company").otherwise("person").alias("type"), _case(k % 4, F.lit("Any"), F.lit("TARN mills"), F.lit("ada@norvale.example"), F.col("c_name")).alias("name"), F.when(k % 4 == 0, "person:explicit").alias("key"), F.array().cast("array<string>").alias("aliases"),
    )
    mail = spark.createDataFrame([(-1, "person", "Ada Brook", None, ["ada@norvale.example"])], "id bigint, type string, name string, key string, aliases array<string>")
    aliases = spark.createDataFrame([("Tarn Mills", "company:Tarn Mills", "company")], "alias string, key string, type string")
    return build.resolve_refs(refs.unionByName(mail), aliases).filter("id >= 0").select("id", "key")


# ------------------------------------------------------------------ packs
@_query("SELECT n_name || ' ' || n_nationkey AS alias, 'place:' || n_name AS owner, 'agency:A' || n_nationkey AS claimed_by FROM nation WHERE n_nationkey % 2 = 0")
def pack_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.knowledge.pack import Pack

    names = [(r[0], r[1]) for r in star.read(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    one = Pack("one", entities=tuple(("place", n, (f"{n} {k}",), "") for k, n in names))
    two = Pack("two", requires=("one",), entities=tuple(("agency", f"A{k}", (f"{n} {k}",) if k % 2 == 0 else (), "") for k, n in names))
    return merge(["two"], {"one": one, "two": two}).conflicts(spark)


@_query("SELECT 'place:' || n_name AS key, list_sort(list_distinct([n_name, 'alias ' || n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'more ' || n_nationkey ELSE n_name END])) AS aliases, CASE WHEN n_nationkey % 3 = 0 THEN 'later' ELSE 'first' END AS description FROM nation")
def packs_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.knowledge.pack import Pack

    names = [(r[0], r[1]) for r in star.read(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    one = Pack("one", entities=tuple(("place", n, (f"alias {k}", f"gone {k}"), "first") for k, n in names))
    two = Pack("two", requires=("one",), suppress=tuple(f"gone {k}" for k, _ in names), entities=tuple(("place", n, (f"more {k}", f"alias {(k + 1) % len(names)}"), "later") for k, n in names if k % 3 == 0))
    return merge(["two"], {"one": one, "two": two}).entity_table(spark).select("key", "aliases", "description")


# ------------------------------------------------------------------ documents, entities, relations
@_query(f"WITH {_STATS} SELECT entity_id, sum(count)::BIGINT AS count, array_to_string(list_sort(list(DISTINCT page_no)), ',') AS pages, name, 'company' AS type FROM ment JOIN ents ON id = entity_id WHERE doc_id = '7' GROUP BY ALL")
def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, mentions = star.corpus(spark, sf_dir)
    return D.document_entities(mentions, entities, "7").withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@_query("""SELECT DISTINCT o_custkey AS src, 1000000000 + l_suppkey AS dst, 'ordered from' AS type, c_name AS src_name, s_name AS dst_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderkey = 7""")
def document_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.operators import relations as R

    c, s = star.read(spark, sf_dir, "customer"), star.read(spark, sf_dir, "supplier")
    ids = c.select(F.concat(F.lit("customer:"), _s("c_custkey")).alias("key"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    ids = ids.unionAll(s.select(F.concat(F.lit("supplier:"), _s("s_suppkey")), F.col("s_suppkey") + 1000000000, "s_name"))
    evidence = R.relation_docs(star.raw_relations(spark, sf_dir), ids.select("key", "id"))
    return D.document_relations(evidence, ids, "7").select("src", "dst", "type", "src_name", "dst_name")


@_query("SELECT p_type AS type, count(*) AS n, sum(p_size % 2)::BIGINT AS auto FROM part GROUP BY 1")
def entity_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.type_counts(star.read(spark, sf_dir, "part").select(F.col("p_type").alias("type"), (F.col("p_size") % 2).alias("auto")))


@_query("""WITH c AS (SELECT p_brand AS type, p_partkey AS id, p_size AS doc_count FROM part) SELECT type, id, doc_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY doc_count DESC, id)::INT AS rank FROM c) WHERE rank <= 12""")
def top_entities_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.top_per_type(star.read(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.col("p_partkey").alias("id"), F.col("p_size").alias("doc_count")))


@_query("""WITH h AS (SELECT doc_id, entity_id, sum(count)::BIGINT AS n FROM ment WHERE doc_id IN ('1', '2', '3', '5', '7', '11') GROUP BY ALL) SELECT doc_id, entity_id, n, name, rank FROM (SELECT h.*, name, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, entity_id)::INT AS rank FROM h JOIN ents ON id = entity_id) WHERE rank <= 2""".replace("WITH h", f"WITH {_STATS}, h"))
def context_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, mentions = star.corpus(spark, sf_dir)
    results = spark.createDataFrame([(x,) for x in ("1", "2", "3", "5", "7", "11")], "doc_id string")
    return D.context_chips(mentions, entities, results, ("company",), 2).select("doc_id", "entity_id", "n", "name", "rank")


@_query("SELECT lang AS corpus_id, doc_id, -n_chars::DOUBLE AS score, rank::INT AS rank, least(total, 20)::INT AS total FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY -n_chars, doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS total FROM documents WHERE lang IS NOT NULL) WHERE rank <= 5")
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).filter("lang is not null").select(F.col("lang").alias("corpus_id"), "doc_id", (-F.col("n_chars")).cast("double").alias("score"))
    return SE.search_all(rows, 5, 20).withColumn("total", F.col("total").cast("int"))


# ------------------------------------------------------------------ full text
_WORDS = "w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents)"
_FTS = {
    "phrase": (SE.Phrase(("of", "the")), "len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) > 0"),
    "prefix": (SE.Phrase(("licen",), prefix=True), "len(list_filter(t, lambda x: starts_with(x, 'licen'))) > 0"),
    "first": (SE.Phrase(("the",), first=True), "len(t) > 0 AND t[1] = 'the'"),
    "and": (SE.Op("AND", SE.Phrase(("the",)), SE.Phrase(("license",))), "list_contains(t, 'the') AND list_contains(t, 'license')"),
    "not": (SE.Op("NOT", SE.Phrase(("the",)), SE.Phrase(("of",))), "list_contains(t, 'the') AND NOT list_contains(t, 'of')"),
    "near": (SE.Near((SE.Phrase(("this",)), SE.Phrase(("with",))), 3), "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'this' AND len(list_filter(range(greatest(1, i - 4), least(len(t), i + 4) + 1), lambda j: t[j] = 'with')) > 0)) > 0"),
}


@_query(f"WITH {_WORDS} " + " UNION ALL ".join(f"SELECT '{n}' AS query, doc_id FROM w WHERE {cond}" for n, (_, cond) in _FTS.items()))
def full_text_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sextant.scratch import cut

    index = SE.simple_postings(_docs(spark, sf_dir), "doc_id", "text")
    wanted = cut(index.filter(F.col("term").isin("of", "the", "license", "this", "with") | F.col("term").startswith("licen")))
    out = None
    for name, (tree, _) in _FTS.items():
        found = SE.matching(wanted, tree).select(F.lit(name).alias("query"), F.col("uid").alias("doc_id"))
        out = found if out is None else out.unionAll(found)
    return out


def _browser(spark: SparkSession, sf_dir: str) -> SE.Index:
    """An index over orders without texts, for what needs no terms."""
    none = spark.createDataFrame([], "uid string, term string, tf int, positions array<int>, length int")
    return SE.Index(none, star.documents(spark, sf_dir), none, none, SE.Statistics(0, 0.0), SE.Statistics(0, 0.0))


@_query(f"""WITH {_STATS}, a AS (SELECT doc_id, -sum(count)::DOUBLE AS score FROM ment WHERE entity_id = 1 GROUP BY 1)
SELECT a.doc_id, score FROM a JOIN docs ON docs.id = a.doc_id WHERE a.doc_id IN (SELECT doc_id FROM ment WHERE entity_id = 2) AND year >= 1995 AND collection = '1-URGENT'""")
def search_by_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = SE.search(_browser(spark, sf_dir), "", {"collection": "1-URGENT"}, 1995, None, star.mentions(spark, sf_dir), 1, 2)
    return found.select("doc_id", "score")


@_query("SELECT o_orderkey::VARCHAR AS doc_id, 0.0::DOUBLE AS score FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996 AND o_orderstatus = 'F'")
def browse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.search(_browser(spark, sf_dir), "*", {"kind": "F"}, 1994, 1996).select("doc_id", F.col("score").cast("double").alias("score"))


@_query("SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN '\"' || lower(n_name) || '\" \"x\"' WHEN 1 THEN n_name || ' OR x' WHEN 2 THEN '' ELSE '\"' || n_name || '\"' END AS query FROM nation")
def rewritten_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _case(F.col("n_nationkey") % 4, F.concat(F.lit(" "), F.lower("n_name"), F.lit(", x ")), F.concat("n_name", F.lit(" OR x")), F.lit(" "), F.col("n_name"))
    rewrite = F.pandas_udf(lambda s: s.map(SE.rewrite), "string")
    return star.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), rewrite(typed).alias("query"))


# ------------------------------------------------------------------ graphs and timelines
@_query(f"""WITH {_RELATIONS}, u AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(docs)::BIGINT AS docs FROM rel GROUP BY ALL),
n AS (SELECT c_custkey AS id, c_custkey % 97 AS dc FROM customer UNION ALL SELECT 1000000000 + s_suppkey, 500 FROM supplier),
top AS (SELECT id FROM n WHERE id IN (SELECT src FROM u UNION SELECT dst FROM u) ORDER BY dc DESC, id LIMIT 400),
ind AS (SELECT * FROM u WHERE src IN (FROM top) AND dst IN (FROM top)),
r AS (SELECT src, dst, row_number() OVER (PARTITION BY node ORDER BY docs DESC, src, dst) AS k FROM (SELECT *, src AS node FROM ind UNION ALL SELECT *, dst FROM ind))
SELECT * FROM ind WHERE (src, dst) IN (SELECT (src, dst) FROM r WHERE k <= 2)""")
def relation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = star.read(spark, sf_dir, "customer"), star.read(spark, sf_dir, "supplier")
    nodes = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 97).alias("doc_count")).unionAll(s.select(F.col("s_suppkey") + 1000000000, F.lit(500).cast("bigint")))
    return GR.relation_graph(_relations(spark, sf_dir), nodes, 400, 2)


@_query(f"""WITH {_EDGES}, top AS (SELECT id, doc_count FROM ids WHERE doc_count <= (SELECT quantile_disc(doc_count, 0.9) FROM ids) ORDER BY doc_count DESC, id LIMIT 20),
l AS (SELECT * FROM edges WHERE docs >= 3 AND src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)) SELECT src, dst, docs FROM l""")
def bounded_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, entities, _ = _edges(spark, sf_dir)
    limit = entities.agg(F.expr("percentile_disc(0.9) within group (order by doc_count)")).first()[0]
    return GR.analysis_graph(entities.select("id", "doc_count"), edges, int(limit), 20, 3)[1].select("src", "dst", "docs")


def _pagerank_sql(rounds: int = 20, damping: float = 0.85) -> str:
    """The iteration unrolled: a table of ranks per round."""
    steps = []
    for k in range(rounds):
        steps.append(f"""i{k} AS MATERIALIZED (SELECT dst AS node, sum(rank * p) AS got FROM share JOIN r{k} ON node = src GROUP BY dst),
r{k + 1} AS MATERIALIZED (SELECT nodes.node, (1 - {damping} + {damping} * (1 - (SELECT coalesce(sum(got), 0) FROM i{k}))) / n + {damping} * coalesce(got, 0) AS rank FROM nodes LEFT JOIN i{k} USING (node), total)""")
    return f"""WITH {_RELATIONS}, tot AS (SELECT src, sum(docs)::DOUBLE AS t FROM rel GROUP BY src), share AS MATERIALIZED (SELECT rel.src, dst, docs / t AS p FROM rel JOIN tot ON tot.src = rel.src),
nodes AS MATERIALIZED (SELECT src AS node FROM share UNION SELECT dst FROM share), total AS (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS (SELECT node, 1 / n AS rank FROM nodes, total),
{", ".join(steps)} SELECT node, round(rank, 9) AS rank FROM r{rounds}"""


@_query(_pagerank_sql())
def pagerank_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GR.pagerank(_relations(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


@_query("SELECT min(y)::INT AS lo, max(y)::INT AS hi FROM (SELECT year(o_orderdate) AS y FROM orders) WHERE y BETWEEN 1993 AND 1997")
def year_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.year_bounds(star.documents(spark, sf_dir), 1993, 1997)


_DENSE = f"""WITH {_STATS}, tot AS (SELECT year, count(*) AS total FROM docs WHERE doc_date LIKE '%-01-0%' GROUP BY year HAVING count(*) >= 5),
c AS (SELECT entity_id, year, count(DISTINCT doc_id) AS n FROM ment JOIN docs ON id = doc_id WHERE entity_id <= 2 AND doc_date LIKE '%-01-0%' GROUP BY ALL)"""


@_query(f"{_DENSE} SELECT e::INT AS entity_id, tot.year, coalesce(n, 0)::DOUBLE AS value FROM tot CROSS JOIN range(1, 3) r(e) LEFT JOIN c ON c.entity_id = e AND c.year = tot.year")
def dense_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = star.documents(spark, sf_dir).filter("doc_date like '%-01-0%'")
    return T.series(star.mentions(spark, sf_dir), docs, [1, 2], 1900, 2100, min_year_docs=5)


@_query(f"{_DENSE} SELECT year, round(100.0 * coalesce(sum(n) FILTER (entity_id = 1), 0) / any_value(total), 2)::DOUBLE AS one, round(100.0 * coalesce(sum(n) FILTER (entity_id = 2), 0) / any_value(total), 2)::DOUBLE AS two FROM tot LEFT JOIN c USING (year) GROUP BY year")
def timeline_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = star.documents(spark, sf_dir).filter("doc_date like '%-01-0%'")
    series = T.series(star.mentions(spark, sf_dir), docs, [1, 2], 1900, 2100, share=True, min_year_docs=5)
    return T.matrix(series, spark.createDataFrame([(1, "one"), (2, "two")], "entity_id int, name string"), [1, 2])


@_query("SELECT o_orderpriority AS corpus_id, count(*)::VARCHAR AS documents, min(year(o_orderdate))::VARCHAR AS first FROM orders GROUP BY 1")
def build_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = star.documents(spark, sf_dir)
    meta = docs.groupBy("corpus_id").agg(F.count(F.lit(1)).cast("string").alias("documents"), F.min("year").cast("string").alias("first"))
    return build.status(meta.unpivot("corpus_id", ["documents", "first"], "k", "v")).select("corpus_id", "documents", "first")


# ------------------------------------------------------------------ all corpora
_ONE_KEY = "(SELECT min(gkey) FROM local)"


def _one(local: DataFrame) -> str:
    return local.agg(F.min("gkey")).first()[0]


@_query(f"""WITH {_LOCAL}, o AS (SELECT * FROM local WHERE gkey = {_ONE_KEY}), v AS (SELECT o.cid, count(DISTINCT doc_id) AS docs FROM m JOIN o ON o.cid = m.cid AND o.key = m.key GROUP BY 1)
SELECT o.cid, max_by(key, (doc_count, key)) AS key, any_value(v.docs) AS docs, sum(doc_count)::BIGINT AS mentions FROM o JOIN v USING (cid) GROUP BY o.cid""")
def entity_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, mentions = _local(spark, sf_dir)
    return G.presence(local, G.distinct_docs(local, mentions), _one(local))


@_query(f"""WITH {_LOCAL}, two AS (SELECT DISTINCT gkey FROM local ORDER BY gkey LIMIT 2), f AS (SELECT DISTINCT m.cid, doc_id, gkey FROM m JOIN local ON local.cid = m.cid AND local.key = m.key WHERE gkey IN (FROM two)),
b AS (SELECT cid, doc_id FROM f GROUP BY ALL HAVING count(*) = 2) SELECT cid AS corpus_id, count(*) AS docs FROM b GROUP BY 1""")
def pair_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, mentions = _local(spark, sf_dir)
    keys = [r[0] for r in local.select("gkey").distinct().orderBy("gkey").limit(2).collect()]
    return G.pair_documents(mentions, local, *(keys * 2)[:2])


@_query(f"""WITH {_LOCAL}, o AS (SELECT cid, key FROM local WHERE gkey = {_ONE_KEY}), c AS (SELECT m.cid AS corpus_id, doc_id::VARCHAR AS doc_id, count(*) AS mentions FROM m JOIN o ON o.cid = m.cid AND o.key = m.key GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY mentions DESC, doc_id) AS k FROM c) SELECT corpus_id, doc_id, mentions FROM t WHERE k <= 30 ORDER BY mentions DESC, corpus_id, doc_id LIMIT 30""")
def merged_top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, mentions = _local(spark, sf_dir)
    own = local.filter(F.col("gkey") == _one(local)).select(F.col("cid").alias("corpus_id"), "key")
    counts = mentions.join(own, ["corpus_id", "key"], "left_semi").groupBy("corpus_id", "doc_id").agg(F.count(F.lit(1)).alias("mentions"))
    return G.merged_top(counts, 30)


@_query("""WITH r AS (SELECT o_orderpriority AS cid, l_suppkey % 5 AS v, CASE WHEN l_linenumber % 2 = 0 THEN 'out' ELSE 'in' END AS dir, l_returnflag AS type, 'g' || l_suppkey % 3 AS gkey, count(*) AS docs, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE strftime(min(o_orderdate), '%Y-%m-%d') END AS fd, CASE WHEN l_suppkey % 5 = 1 THEN '' ELSE strftime(max(o_orderdate), '%Y-%m-%d') END AS ld
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY cid, v, l_suppkey, dir, type, gkey),
p AS (SELECT cid, dir, type, gkey, max(docs) AS docs, min(nullif(fd, '')) AS fd, max(nullif(ld, '')) AS ld FROM r GROUP BY ALL)
SELECT dir, type, gkey, sum(docs)::BIGINT AS docs, min(fd) AS first_date, max(ld) AS last_date FROM p GROUP BY ALL""")
def global_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = star.read(spark, sf_dir, "lineitem").join(star.read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.concat(F.lit("g"), (F.col("l_suppkey") % 3).cast("string"))
    rows = joined.groupBy(F.col("o_orderpriority").alias("cid"), "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, "out").otherwise("in").alias("dir"), F.col("l_returnflag").alias("type"), key.alias("gkey")).agg(
        F.count(F.lit(1)).alias("docs"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("b")
    )
    fifth = F.col("l_suppkey") % 5
    return G.relations(rows.select("cid", "dir", "type", "gkey", "docs", F.when(fifth == 0, "").otherwise(F.col("a")).alias("first_date"), F.when(fifth == 1, "").otherwise(F.col("b")).alias("last_date")))


@_query("SELECT o_orderpriority AS cid, count(*) AS docs, min(CASE WHEN y BETWEEN 1994 AND 1996 THEN y END)::INT AS lo, max(CASE WHEN y BETWEEN 1994 AND 1996 THEN y END)::INT AS hi FROM (SELECT o_orderpriority, year(o_orderdate) AS y FROM orders) GROUP BY 1")
def corpus_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.corpus_bounds(star.documents(spark, sf_dir), 1994, 1996)


# ------------------------------------------------------------------ measures without a built-in
def _betweenness_sql(levels: int = 12) -> str:
    """Shortest paths level by level, and every node's share of each pair's paths."""
    steps = [f"l{k + 1} AS MATERIALIZED (SELECT l.s, adj.dst AS v, sum(l.n) AS n FROM l{k} l JOIN adj ON adj.src = l.v WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT s, v FROM l{j}' for j in range(k + 1))}) x WHERE x.s = l.s AND x.v = adj.dst) GROUP BY l.s, adj.dst)" for k in range(levels)]
    every = " UNION ALL ".join(f"SELECT s, v, {k} AS d, n FROM l{k}" for k in range(levels + 1))
    return f"""WITH {_EDGES},
r AS (SELECT src, dst, row_number() OVER (PARTITION BY node ORDER BY docs DESC, src, dst) AS k FROM (SELECT src, dst, docs, src AS node FROM edges UNION ALL SELECT src, dst, docs, dst FROM edges)),
g AS MATERIALIZED (SELECT DISTINCT src, dst FROM r WHERE k <= 3), adj AS MATERIALIZED (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g),
l0 AS MATERIALIZED (SELECT DISTINCT src AS s, src AS v, 1::HUGEINT AS n FROM adj), {", ".join(steps)}, p AS MATERIALIZED ({every}), nn AS (SELECT count(*)::DOUBLE AS n FROM l0),
b AS (SELECT a.v, sum(a.n::DOUBLE * c.n / t.n) AS bc FROM p a JOIN p c ON c.s = a.v AND c.v <> a.v JOIN p t ON t.s = a.s AND t.v = c.v AND t.d = a.d + c.d WHERE a.s <> a.v AND c.v <> a.s GROUP BY a.v)
SELECT l0.v::BIGINT AS id, round(coalesce(bc, 0) / ((nn.n - 1) * (nn.n - 2)), 9) AS betweenness, round(coalesce(bc, 0) / ((nn.n - 1) * (nn.n - 2)) / sqrt(doc_count), 9) AS bridge FROM l0 LEFT JOIN b ON b.v = l0.v JOIN ids ON ids.id = l0.v, nn"""


@_query(_betweenness_sql())
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, entities, _ = _edges(spark, sf_dir)
    nodes, found = GR.analysis_graph(entities.select("id", "doc_count"), GR.strongest_links(edges, 3), 10**9, None, 1)
    return GR.betweenness(nodes, found, None).select("id", F.round("betweenness", 9).alias("betweenness"), F.round("bridge", 9).alias("bridge"))


# ------------------------------------------------------------------ views over a corpus and over all
def _corpus(spark: SparkSession, sf_dir: str) -> api.Corpus:
    """The views of one corpus over the star schema."""
    edges, entities, mentions = _edges(spark, sf_dir)
    pages = star.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("pages"))
    docs = star.documents(spark, sf_dir).join(pages, "id", "left").fillna(0, ["pages"]).withColumn("origin", F.col("kind")).withColumn("classification", F.lit(""))
    few = docs.filter("cast(id as bigint) % 100 = 0").select(F.col("id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("title").alias("text"), F.xxhash64("id").alias("page_uid"))
    tables = {"documents": docs, "pages": few, "entities": entities, "mentions": mentions, "edges": edges, "relations": _relations(spark, sf_dir)}
    return api.Corpus(HeldTables(spark, {"star": tables}), "star", 1900, 2100)


@_query(f"""WITH {_STATS}, {_RELATIONS} SELECT 'kind' AS view, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'collection', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM docs GROUP BY 2 UNION ALL SELECT 'entities', 'company', count(*) FROM ids UNION ALL SELECT 'relations', 'ordered from', count(*) FROM rel""")
def view_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _corpus(spark, sf_dir).overview()
    show = lambda name, df, c: df.select(F.lit(name).alias("view"), F.col(c).cast("string").alias("value"), "n")
    out = show("kind", views["by_kind"], "value")
    for name, key, c in (("collection", "by_collection", "value"), ("year", "by_year", "value"), ("entities", "entity_types", "type"), ("relations", "relation_types", "type")):
        out = out.unionAll(show(name, views[key], c))
    return out


@_query(f"""WITH {_STATS}, own AS (SELECT DISTINCT entity_id FROM ment WHERE doc_id = '7')
SELECT doc_id, weight, shared, title, doc_date FROM (SELECT doc_id, round(sum(1.0::DOUBLE / doc_count), 9) AS weight, count(DISTINCT entity_id) AS shared FROM ment JOIN ids ON id = entity_id
WHERE doc_id <> '7' AND entity_id IN (FROM own) GROUP BY doc_id ORDER BY weight DESC, doc_id LIMIT 12) JOIN docs ON docs.id = doc_id""")
def view_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    corpus.catalog.tables["star"]["relation_docs"] = spark.createDataFrame([], "src int, dst int, type string, doc_id string")
    return corpus.document("7")["related"].select("doc_id", "weight", "shared", "title", "doc_date")


@_query(f"""WITH {_EDGES}, near AS (SELECT CASE WHEN src = 2 THEN dst ELSE src END AS other, docs, npmi FROM edges WHERE src = 2 OR dst = 2)
SELECT other, docs, npmi, ents.name FROM (SELECT * FROM near WHERE docs >= 3 ORDER BY npmi DESC, docs DESC, other LIMIT 20) JOIN ents ON id = other""")
def view_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).entity(2)["distinctive"].select("other", "docs", "npmi", "name")


@_query(f"""WITH {_EDGES}, top AS (SELECT id FROM ids ORDER BY doc_count DESC, id LIMIT 30), ind AS (SELECT * FROM edges WHERE docs >= 2 AND src IN (FROM top) AND dst IN (FROM top)),
r AS (SELECT src, dst, row_number() OVER (PARTITION BY node ORDER BY docs DESC, src, dst) AS k FROM (SELECT src, dst, docs, src AS node FROM ind UNION ALL SELECT src, dst, docs, dst FROM ind)),
l AS (SELECT src, dst FROM r WHERE k <= 1) SELECT id, name, doc_count FROM ents WHERE id IN (SELECT src FROM l UNION SELECT dst FROM l)""")
def view_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).graph(["company"], 30, 2, k=1)["nodes"].select("id", "name", "doc_count")


@_query(f"""WITH {_STATS}, tot AS (SELECT year, count(*) AS total FROM docs GROUP BY year), c AS (SELECT entity_id, year, count(DISTINCT doc_id) AS n FROM ment JOIN docs ON id = doc_id WHERE entity_id IN (2, 4) GROUP BY ALL),
g AS (SELECT e::INT AS entity_id, year, total FROM tot, (VALUES (2), (4)) r(e)) SELECT g.entity_id, g.year, round(100.0::DOUBLE * coalesce(n, 0) / total, 2) AS value FROM g LEFT JOIN c USING (entity_id, year)""")
def view_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).timeline([2, 4], share=True)


@_query(f"""WITH {_STATS} SELECT 'list' AS view, id, name FROM (SELECT id, name FROM ents WHERE contains(lower(name), '5') ORDER BY doc_count DESC, id LIMIT 9)
UNION ALL SELECT 'typed', id, name FROM (SELECT * FROM ents WHERE contains(lower(name), 'supplier#000000002') ORDER BY lower(name) = 'supplier#000000002' DESC, doc_count DESC, id LIMIT 20)""")
def view_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    listed = corpus.entities("company", "5", True, 9).select(F.lit("list").alias("view"), "id", "name")
    return listed.unionAll(corpus.autocomplete("SUPPLIER#000000002").select(F.lit("typed"), "id", "name"))


@_query("""SELECT id, doc_date FROM (SELECT o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y-%m-%d') AS doc_date FROM orders WHERE year(o_orderdate) >= 1995 AND o_orderstatus = 'O') ORDER BY doc_date, id LIMIT 25 OFFSET 50""")
def view_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _corpus(spark, sf_dir).search("*", "date_asc", 3, facets={"kind": "O"}, year_from=1995)
    return found["results"].select("id", "doc_date")


_TWO = ("1-URGENT", "2-HIGH")
_LIBRARIES: dict[tuple, api.Library] = {}


def _orders_documents(spark: SparkSession, sf_dir: str, priority: str, first_year: int = 0) -> DataFrame:
    """The orders of one priority as documents of one page."""
    docs = star.documents(spark, sf_dir).filter((F.col("corpus_id") == priority) & (F.col("year") >= first_year))
    return docs.drop("corpus_id").withColumn("pages", F.lit(1).cast("bigint"))


def _orders_corpus(spark: SparkSession, sf_dir: str, priority: str, first_year: int = 0) -> dict[str, DataFrame]:
    """The tables of a corpus: the orders of one priority, suppliers as entities.  Each
    is written once, and what follows from it reads the files."""
    docs = cut(_orders_documents(spark, sf_dir, priority, first_year))
    own = star.raw_mentions(spark, sf_dir).join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    facts = cut(M.mention_facts(own))
    ids = cut(M.entity_ids(M.entity_stats(facts, docs)))
    mentions = cut(M.encode(facts, ids))
    drop(facts)
    names = star.read(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), _s("s_suppkey")).alias("key"), F.col("s_name").alias("name"))
    entities = cut(ids.join(names, "key").select("*", F.lit("company").alias("type"), F.lit("").alias("description"), F.lit(0).alias("auto"), F.array("name").alias("aliases")))
    edges = cut(E.edges(mentions, ids.select(F.col("id").alias("entity_id"), "doc_count"), F.lit(docs.count())))
    drop(ids)
    return {"documents": docs, "entities": entities, "mentions": mentions, "edges": edges}


def _changed_at(spark: SparkSession, sf_dir: str, *tables: str) -> tuple:
    """When the tables' files changed last."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet") for t in tables]
    return tuple(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths)


def _library(spark: SparkSession, sf_dir: str) -> api.Library:
    """Two corpora of orders and their global index, built once for unchanged tables."""
    name = (spark.sparkContext.applicationId, sf_dir, _changed_at(spark, sf_dir, "orders", "lineitem", "supplier"))
    if name not in _LIBRARIES:
        library = api.Library(HeldTables(spark, {k: _orders_corpus(spark, sf_dir, k) for k in _TWO}), 1900, 2100)
        library.build_global()
        _LIBRARIES.clear()
        _LIBRARIES[name] = library
    return _LIBRARIES[name]


_BOTH = """d AS (SELECT o_orderkey AS id, o_orderpriority AS cid, year(o_orderdate)::INT AS year FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
m AS (SELECT DISTINCT cid, year, id AS doc_id, l_suppkey AS s FROM lineitem JOIN d ON id = l_orderkey),
e AS (SELECT 'company:' || lower(s_name) AS gkey, s_name AS name, count(*) AS doc_count, count(DISTINCT cid) AS n_corpora, min(year)::INT AS first_year, max(year)::INT AS last_year FROM m JOIN supplier ON s = s_suppkey GROUP BY ALL)"""


@_query(f"WITH {_BOTH} SELECT * FROM e")
def all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _library(spark, sf_dir).table("entities").select("gkey", "name", "doc_count", "n_corpora", "first_year", "last_year")


@_query(f"WITH {_BOTH} SELECT cid AS corpus_id, count(*) AS documents, count(*)::BIGINT AS pages, min(year)::INT AS first_year, max(year)::INT AS last_year FROM d GROUP BY cid")
def all_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards read documents alone: no index is built for them."""
    return api.Library(HeldTables(spark, {k: {"documents": _orders_documents(spark, sf_dir, k)} for k in _TWO}), 1900, 2100).library()


@_query(f"""WITH {_BOTH}, one AS (SELECT s_suppkey AS s, 'company:' || lower(s_name) AS gkey FROM supplier ORDER BY s_name LIMIT 1), t AS (SELECT year, count(*) AS total FROM d GROUP BY year),
c AS (SELECT year, count(*) AS n FROM m WHERE s = (SELECT s FROM one) GROUP BY year) SELECT gkey, t.year, round(100.0::DOUBLE * coalesce(n, 0) / total, 2) AS value FROM t CROSS JOIN one LEFT JOIN c USING (year)""")
def all_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = _library(spark, sf_dir)
    return library.timeline([library.table("entities").agg(F.min("gkey")).first()[0]], share=True)


@_query(f"""WITH {_BOTH}, one AS (SELECT s_suppkey AS s FROM supplier ORDER BY s_name LIMIT 1) SELECT year, count(*) FILTER (cid = '1-URGENT') AS urgent, count(*) FILTER (cid = '2-HIGH') AS high FROM m WHERE s = (SELECT s FROM one) GROUP BY year""")
def years_by_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = _library(spark, sf_dir)
    found = library.by_year_and_corpus(library.table("entities").agg(F.min("gkey")).first()[0])
    return found.select("year", F.col("`1-URGENT`").alias("urgent"), F.col("`2-HIGH`").alias("high"))


_GLOBAL_LINKS = f"""WITH {_BOTH}, f AS (SELECT l_orderkey AS id, l_suppkey AS s, (l_linenumber - 1) // 5 AS w FROM lineitem), pr AS (SELECT DISTINCT cid, d.id, a.s AS x, b.s AS y FROM d JOIN f a ON a.id = d.id JOIN f b ON b.id = d.id AND a.w = b.w AND a.s < b.s),
pc AS (SELECT cid, x, y, count(*) AS docs FROM pr GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT s_suppkey AS s, 'company:' || lower(s_name) AS g FROM supplier),
l AS (SELECT least(p.g, q.g) AS a, greatest(p.g, q.g) AS b, sum(docs)::BIGINT AS docs, count(*) AS n_corpora FROM pc JOIN k p ON p.s = x JOIN k q ON q.s = y GROUP BY ALL)"""


@_query(f"{_GLOBAL_LINKS}, one AS (SELECT min(a) AS g FROM l) SELECT CASE WHEN a = g THEN b ELSE a END AS gkey, docs, e.name, e.doc_count FROM l, one JOIN e ON e.gkey = CASE WHEN a = g THEN b ELSE a END WHERE a = g OR b = g")
def all_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = _library(spark, sf_dir)
    return library.entity(library.table("links").agg(F.min("a")).first()[0])["neighbours"].select("gkey", "docs", "name", "doc_count")


@_query(f"""{_GLOBAL_LINKS}, top AS (SELECT gkey FROM e ORDER BY doc_count DESC, gkey LIMIT 15), ind AS (SELECT a AS src, b AS dst, docs FROM l WHERE docs >= 2 AND a IN (FROM top) AND b IN (FROM top)),
r AS (SELECT src, dst, row_number() OVER (PARTITION BY node ORDER BY docs DESC, src, dst) AS k FROM (SELECT *, src AS node FROM ind UNION ALL SELECT *, dst FROM ind)) SELECT src, dst, docs FROM ind WHERE (src, dst) IN (SELECT (src, dst) FROM r WHERE k <= 2)""")
def all_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _library(spark, sf_dir).graph(15, 2, 2)["links"].select("src", "dst", "docs")


@_query(f"WITH {_BOTH}, l AS (SELECT cid, s, count(*) AS doc_count FROM m GROUP BY ALL) SELECT cid, 'supplier:' || s AS key, doc_count FROM l WHERE cid = '2-HIGH' AND s = (SELECT s_suppkey FROM supplier ORDER BY s_name LIMIT 1)")
def also_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = _library(spark, sf_dir)
    key = library.table("local").filter(F.col("cid") == _TWO[0]).orderBy("name").first()["key"]
    return library.also_in(_TWO[0], key).select("cid", "key", "doc_count")


@_query(f"WITH {_BOTH} SELECT gkey, n_corpora, doc_count FROM e WHERE n_corpora > 1 ORDER BY n_corpora DESC, doc_count DESC, gkey LIMIT 20")
def across_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _library(spark, sf_dir).across(20).select("gkey", "n_corpora", "doc_count")
