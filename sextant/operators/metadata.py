"""Metadata of documents, by chains of precedence: title, collection, publisher,
dates, classification, origin, author and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import dates as DT
from sextant.functions.text import basename, java_regex, map_get, normalise_space, without_extension
from sextant.knowledge.pack import Knowledge, OriginRule

#: Embedded titles that say nothing.  Fixed values.
JUNK_TITLE = (
    r"(?i)^(?:microsoft|untitled|slide ?\d|presentation|document\d*|powerpoint|pdf|title|print|[^\p{L}\p{N}_]*$|[\w\-]+\.(?:pdf|ppt|pptx|doc|docx)$|[a-f0-9\-]{16,}$)"
)


def _some(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def strip_boilerplate(text: Column, patterns: list[str]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, java_regex(p), " ")
    return text


def pretty_name(path: Column, strip: str = "") -> Column:
    base = without_extension(basename(path))
    if strip:
        base = F.regexp_replace(base, f"(?i){java_regex(strip)}", "")
    name = normalise_space(F.translate(base, "_-", "  "))
    return F.coalesce(_some(name), path)


def title(meta_title: Column, embedded: Column, kind: Column, first: Column, member: Column, path: Column, strip: str = "") -> Column:
    """Given title, else a sane embedded one, else the first words of HTML, else a
    readable member or file name."""
    own = F.regexp_replace(F.coalesce(embedded, F.lit("")), r"<[^>]+>", "")
    own = F.regexp_replace(F.regexp_replace(own, r"^\s*\([A-Z/ ]{1,30}\)\s*", ""), r"^Microsoft (?:PowerPoint|Word) - ", "")
    own = normalise_space(own)
    sane = F.when((F.length(own) > 6) & ~own.rlike(JUNK_TITLE), F.substring(own, 1, 200))
    words = F.when(kind == "html", _some(F.substring(normalise_space(F.substring(first, 1, 200)), 1, 120)))
    named = F.when(_some(member).isNotNull(), pretty_name(member, strip)).otherwise(pretty_name(F.replace(path, F.lit(" (page scans)"), F.lit("")), strip))
    return F.coalesce(_some(meta_title), sane, words, named)


def collection(given: Column, path: Column, depth: int = 1, aliases: dict[str, str] | None = None) -> Column:
    """Given, else the archive's name, else the first folders; files without a
    folder are of the top level."""
    archive = F.regexp_replace(basename(F.substring_index(path, "!/", 1)), r"(?i)\.(?:zip|7z|rar|tar|tgz|tbz2?|txz|tar\.(?:gz|bz2|xz))$", "")
    parts = F.split(path, "/")
    folders = F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/")
    found = F.when(path.contains("!/"), map_get(aliases or {}, archive)).when(F.size(parts) <= 1, "(top level)").otherwise(map_get(aliases or {}, folders))
    return F.coalesce(_some(given), found)


def first_rule(rules: list[tuple[Column, str]], default: str = "") -> Column:
    """Label of the first condition that holds."""
    out = F.lit(default)
    for condition, label in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(label)).otherwise(out)
    return out


def publisher(path: Column, rules: list[tuple[str, str]]) -> Column:
    return first_rule([(path.rlike(java_regex(p)), name) for p, name in rules])


def classification(text: Column, knowledge: Knowledge) -> Column:
    head = F.substring(text, 1, 200_000)
    return first_rule([(head.rlike(java_regex(r.pattern)), r.label) for r in knowledge.classifications])


def origin(text: Column, path: Column, kind: Column, rules: list[OriginRule], html_origin: str = "", default: str = "") -> Column:
    head = F.substring(text, 1, 20_000)
    target = {"path": path, "top": F.substring(text, 1, 3_000), "head": head}
    conditions = []
    for r in rules:
        hit = target[r.target].rlike(java_regex(r.pattern))
        conditions.append((hit & ~head.rlike(java_regex(r.unless)) if r.unless else hit, r.label))
    return F.when(kind == "html", F.lit(html_origin)).otherwise(first_rule(conditions, default))


def author_line(text: Column) -> Column:
    """FROM: and the line after it, unless that is a run date."""
    # the pattern is a fixed value
    head, pattern = F.substring(text, 1, 3000), r"FROM:\s*\n?\s*([^\n]{3,120})\n\s*([^\n]{0,120})"
    a, b = (normalise_space(F.regexp_extract(head, pattern, k)) for k in (1, 2))
    b = F.when(F.lower(b).startswith("run date"), "").otherwise(b)
    return F.substring(F.when((a != "") & (b != ""), F.concat(a, F.lit(" — "), b)).otherwise(a), 1, 200)


def doc_date(given: Column, path: Column, text: Column, knowledge: Knowledge, dates: dict) -> Column:
    """Date and how it was found, as a struct: given, file name, hints by priority,
    first date in the text."""
    lo, hi = dates["min_year"], dates["max_year"]
    found = [(_some(given), "metadata"), (_some(DT.from_filename(path, lo, hi)), "file name")]
    found += [(_some(hint(text)), "date in header (est.)") for _, hint in knowledge.date_hints]
    found.append((_some(DT.from_text(text, dates["text_min_year"], dates["text_max_year"])), "first date in text (est.)"))
    structs = [F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(s).alias("source"))) for d, s in found]
    return F.coalesce(*structs, F.struct(F.lit("").alias("date"), F.lit("").alias("source")))


def summary(pages: Column) -> Column:
    """600 characters of the first two pages' text."""
    return F.substring(normalise_space(F.array_join(F.slice(pages["text"], 1, 2), "\n")), 1, 600)


def document_metadata(docs: DataFrame, knowledge: Knowledge, config: dict) -> DataFrame:
    """Extracted documents with their derived columns.

    docs: relpath, kind, title, author, doc_date, origin, classification, member,
    collection, pages, fields, attachments (nulls where there is nothing)."""
    for hook in knowledge.metadata:
        docs = hook(docs)
    md, dates = config["metadata"], config["dates"]
    raw = F.array_join(F.col("pages")["text"], "\n")
    docs = docs.withColumn("m_text", strip_boilerplate(raw, knowledge.strip))
    text, path, kind = F.col("m_text"), F.col("relpath"), F.col("kind")
    dated = docs.withColumn("m_date", doc_date(F.col("doc_date"), path, text, knowledge, dates))
    fields = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    attached = F.when((F.size("attachments") > 0) & ~F.map_contains_key(fields, "Attachments"), F.map_concat(fields, F.create_map(F.lit("Attachments"), F.array_join("attachments", ", ")))).otherwise(fields)
    published = F.coalesce(*[_some(f(path)) for f in knowledge.published], F.lit(""))
    rules = [(r["pattern"], r["label"]) if isinstance(r, dict) else tuple(r) for r in md["publisher_rules"]]
    return dated.select(
        F.substring(F.sha1(path.cast("binary")), 1, 12).alias("id"), "relpath", basename(path).alias("filename"), "kind",
        title(F.col("title"), F.col("title"), kind, F.col("pages")[0]["text"], F.col("member"), path, md["title_strip"]).alias("title"),
        collection(F.col("collection"), path, md["collection_depth"], md["collection_aliases"]).alias("collection"),
        publisher(path, rules).alias("publisher"), published.alias("published"),
        F.col("m_date.date").alias("doc_date"), F.col("m_date.source").alias("date_source"), DT.year_of(F.col("m_date.date")).alias("year"),
        F.size("pages").alias("pages"), F.length(raw).cast("bigint").alias("chars"), F.size(F.filter("pages", lambda p: p["ocr"] == 1)).alias("ocr_pages"),
        F.coalesce(_some(F.col("origin")), origin(text, path, kind, knowledge.origins, md["html_origin"], md["default_origin"])).alias("origin"),
        F.coalesce(_some(F.col("classification")), classification(text, knowledge)).alias("classification"),
        F.coalesce(_some(F.col("author")), F.when(kind == "pdf", author_line(text)), F.lit("")).alias("author"),
        summary(F.col("pages")).alias("summary"), F.sha1(F.concat(path, F.lit("\0"), raw).cast("binary")).alias("sha1"), "member", attached.alias("fields"), F.col("pages").alias("page_list"),
    )


def header_fields(text: Column, keys: tuple[str, ...]) -> Column:
    """``KEY: value`` lines of a form's first 4,000 characters, as a map."""
    head = F.substring(text, 1, 4000)
    pattern = rf"(?m)^[ \t]*({'|'.join(keys)})[ \t]*:[ \t]*(.+)$"
    names, values = (F.regexp_extract_all(head, F.lit(pattern), F.lit(k)) for k in (1, 2))
    pairs = F.array_distinct(F.transform(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p: F.struct(p["k"].alias("k"), F.trim(p["v"]).alias("v"))))
    first = F.filter(pairs, lambda p: (p["v"] != "") & (F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == F.array_position(pairs, p)))
    return F.map_from_entries(first)


def cable_header(text: Column, topics: dict[str, str], places: dict[str, str], orgs: dict[str, str]) -> Column:
    """Subject, topic codes, entities and post of a cable, as a struct.

    topics, places, orgs: what each code stands for (the user's own tables)."""
    head = F.substring(text, 1, 5000)
    subject = normalise_space(F.regexp_extract(head, r"(?s)SUBJ(?:ECT)?:\s*(.+?)(?:\n\s*\n|\n[A-Z ]{3,20}:|$)", 1))
    codes = F.filter(F.split(F.regexp_extract(head, r"TAGS:?\s*([A-Z0-9, /]+)", 1), r"[\s,/]+"), lambda c: c != "")
    known = {c: ("idea", f"{c} — {t}") for c, t in topics.items()} | {c: ("place", t) for c, t in places.items()} | {c: ("organization", t) for c, t in orgs.items()}
    pairs = F.create_map(*[x for c, (k, n) in known.items() for x in (F.lit(c), F.struct(F.lit(k).alias("type"), F.lit(n).alias("name")))]) if known else F.create_map().cast("map<string,struct<type:string,name:string>>")
    entities = F.filter(F.transform(codes, lambda c: pairs[c]), lambda e: e.isNotNull())
    kind, post = (F.regexp_extract(head, r"(?m)^\s*FM\s+(AMEMBASSY|AMCONSUL|SECSTATE)\s*([A-Z ]*)", k) for k in (1, 2))
    origin_ = F.when(kind == "SECSTATE", "Department of State").when(kind == "AMCONSUL", F.concat(F.lit("Consulate "), F.initcap(F.trim(post)))).when(kind == "AMEMBASSY", F.concat(F.lit("Embassy "), F.initcap(F.trim(post)))).otherwise("")
    return F.struct(subject.alias("subject"), codes.alias("tags"), entities.alias("entities"), origin_.alias("origin"))
