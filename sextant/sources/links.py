"""Listings of linked files over stored HTML, and the download ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.text import dest_path, links


def absolute(base: Column, href: Column) -> Column:
    """A link as an absolute URL: full, root-relative or relative to the page's folder."""
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/]/)[^/]*$", "")
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), href))


def page_links(pages: DataFrame, extensions: tuple[str, ...] = (), pattern: str | None = None) -> DataFrame:
    """``url, page_url``: each linked URL once, from the first page that has it.
    pages: page_id, url, html.  extensions and a pattern restrict the URLs."""
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(links(F.col("html"))).alias("place", "href"))
    rows = rows.withColumn("url", absolute(F.col("page_url"), F.replace("href", F.lit("&amp;"), F.lit("&"))))
    if extensions:
        rows = rows.filter(F.lower("url").rlike(r"\.(?:" + "|".join(extensions) + r")(?:[?#].*)?$"))
    if pattern:
        rows = rows.filter(F.col("url").rlike(pattern))
    first = F.row_number().over(Window.partitionBy("url").orderBy("page_id", "place"))
    return rows.withColumn("first", first).filter("first = 1").select("url", "page_url")


def first_captures(captures: DataFrame) -> DataFrame:
    """The first capture of each destination path, without regard to its case.
    captures: url, stamp, arrival."""
    rows = captures.withColumn("path", F.lower(dest_path(F.col("url"))))
    first = F.row_number().over(Window.partitionBy("path").orderBy("arrival"))
    return rows.withColumn("first", first).filter("first = 1").drop("first")


def item_files(manifest: DataFrame, pattern: str) -> DataFrame:
    """Original files of an item's manifest that match.  manifest: name, source, size, md5."""
    return manifest.filter((F.col("source") == "original") & F.col("name").rlike(pattern))


def clean_href(href: Column) -> Column:
    """Repairs white space, doubled schemes and entities in a link."""
    out = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    out = F.regexp_replace(out, r"^https?://(?=https?:/)", "")
    return F.replace(F.regexp_replace(out, r"^(https?:)/(?=[^/])", "$1//"), F.lit(" "), F.lit("%20"))


def search_items(responses: DataFrame, suffixes: tuple[str, ...], shard: str | None = None) -> DataFrame:
    """``identifier, path`` of an archive's paged search results, once for each suffix.

    responses: page, body (JSON: {"items": [{"identifier": ...}], "cursor": ...}).
    An item that several pages list counts once, where it comes first.  shard: a
    pattern whose first group is the folder."""
    items = F.from_json("body", F.lit("items array<struct<identifier:string>>, cursor string"))["items"]
    rows = responses.select("page", F.posexplode(items).alias("place", "item")).select("page", "place", "item.identifier")
    first = F.row_number().over(Window.partitionBy("identifier").orderBy("page", "place"))
    rows = rows.filter(F.col("identifier").isNotNull()).withColumn("first", first).filter("first = 1")
    name = F.concat("identifier", F.col("suffix"))
    folder = F.regexp_extract("identifier", shard, 1) if shard else F.lit("")
    path = F.when(folder != "", F.concat(folder, F.lit("/"), name)).otherwise(name)
    return rows.withColumn("suffix", F.explode(F.lit(list(suffixes)))).select("identifier", path.alias("path"))


def post_links(responses: DataFrame, pattern: str = r"\.(?:pdf|zip|docx?|xlsx?)(?:[?#].*)?$") -> DataFrame:
    """``url, post``: files linked in the posts of a site's paged listing, repaired and
    once each.  responses: page, body (JSON array of {"id", "link", "content": {"rendered"}})."""
    posts = F.from_json("body", F.lit("array<struct<id:bigint,link:string,content:struct<rendered:string>>>"))
    rows = responses.select("page", F.explode(posts).alias("p")).select(F.col("p.id").alias("post"), F.col("p.link").alias("link"), F.posexplode(links(F.col("p.content.rendered"))).alias("place", "href"))
    rows = rows.withColumn("url", absolute(F.col("link"), clean_href(F.col("href")))).filter(F.lower("url").rlike(pattern))
    first = F.row_number().over(Window.partitionBy("url").orderBy("post", "place"))
    return rows.withColumn("first", first).filter("first = 1").select("url", "post")


def waits(requests: DataFrame, least: float = 5.0, most: float = 600.0) -> DataFrame:
    """``host, seq, wait``: seconds before the next request to a host may go, after
    each of its responses.  A refusal (429, 503) doubles the wait from least up to
    most, or takes the server's retry_after; any other response ends the row of
    refusals.  requests: host, seq, status, retry_after (null: none given)."""
    order = Window.partitionBy("host").orderBy("seq")
    refused = F.col("status").isin(429, 503)
    run = F.sum(F.when(refused, 0).otherwise(1)).over(order)
    rows = requests.withColumn("refused", refused).withColumn("run", run)
    nth = F.sum(F.when(F.col("refused"), 1).otherwise(0)).over(Window.partitionBy("host", "run").orderBy("seq"))
    backoff = F.least(F.lit(most), F.lit(least) * F.pow(F.lit(2.0), F.least(nth, F.lit(60)) - 1))
    return rows.select("host", "seq", F.when(F.col("refused"), F.greatest(F.coalesce("retry_after", F.lit(0.0)), backoff)).otherwise(0.0).alias("wait"))


def resumed(files: DataFrame) -> DataFrame:
    """``path, start, action`` of downloads by what is there already: whole files are
    kept, parts go on from their end, and one that is too long begins anew.
    files: path, size (null: unknown), have (bytes of the part; null: none)."""
    have = F.coalesce("have", F.lit(0))
    whole = F.col("size").isNotNull() & (have == F.col("size"))
    action = F.when(whole, "keep").when((have > 0) & (F.col("size").isNull() | (have < F.col("size"))), "resume").otherwise("fetch")
    return files.select("path", F.when(action == "fetch", F.lit(0)).otherwise(have).cast("bigint").alias("start"), action.alias("action"))


def ledger_pending(urls: DataFrame, done: DataFrame) -> DataFrame:
    return urls.join(done.select("url"), "url", "left_anti")


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``path, ok``: sizes and checksums of downloads against their listing.
    files: path, content; expected: path, size, md5, sha256 (nulls are not checked)."""
    have = files.select("path", F.octet_length("content").alias("n"), F.md5("content").alias("m"), F.sha2("content", 256).alias("s"))
    same = lambda a, b: F.coalesce(F.col(a).isNull() | (F.col(a) == F.col(b)), F.lit(True))
    return expected.join(have, "path", "left").select("path", (F.col("n").isNotNull() & same("size", "n") & same("md5", "m") & same("sha256", "s")).alias("ok"))
