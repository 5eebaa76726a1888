"""Full-text search: postings, query language, BM25, facets and snippets.

The index is a table of postings (page or title, term, frequency, positions).
A query is parsed on the driver into a small tree, which becomes joins over the
postings of its terms only.  A text may have several columns: a position tells its
column, so no phrase reaches over two of them and ``author:x`` reads one alone.

A stored index (``StoredIndex``) holds postings in order of term and block of texts,
so that a query's scan skips all others, with the best score of each term in each
block, by which a search for the first k hits skips blocks that cannot have one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.porter import analyze
from sextant.operators.documents import filter_documents
from sextant.scratch import cut, drop

K1, B, TITLE_WEIGHT, MIN_IDF = 1.2, 0.75, 3.0, 1e-6
NEAR_DISTANCE = 10
#: Positions of a column; texts of a block.
COLUMN, BLOCK_TEXTS = 1 << 24, 64
#: Terms and places that Python holds before it hands rows on.
HELD_PLACES = 200_000
#: Blocks that are scored first, to learn what the k-th hit has at least, per hit asked for.
FIRST_BLOCKS = 2


class QuerySyntaxError(ValueError):
    """A query that does not parse; searches report it and return nothing."""


# ------------------------------------------------------------------ index
def posting_frames(batches: Iterator[pd.DataFrame], keep: Callable[[str], bool] | None = None) -> Iterator[pd.DataFrame]:
    """Postings of batches (uid, texts), handed on whenever HELD_PLACES have come together."""
    names = ["uid", "term", "tf", "positions", "length"]
    for batch in batches:
        out, held = [], 0
        for key, values in zip(batch["uid"], batch["texts"], strict=True):
            at: dict[str, list[int]] = {}
            length = 0
            for column, value in enumerate(values):
                terms = analyze(value)
                length += len(terms)
                for k, term in enumerate(terms, column * COLUMN):
                    if keep is None or keep(term):
                        at.setdefault(term, []).append(k)
            out.append((key, None, 0, [], length))
            out += [(key, term, len(places), places, length) for term, places in at.items()]
            held += 1 + length
            if held >= HELD_PLACES:
                yield pd.DataFrame(out, columns=names)
                out, held = [], 0
        yield pd.DataFrame(out, columns=names)


def postings(rows: DataFrame, uid: str, text: str | tuple[str, ...], keep: Callable[[str], bool] | None = None) -> DataFrame:
    """``uid, term, tf, positions, length`` of every text, and a row without a term for
    its length.  text: its column, or several, whose positions start COLUMN apart.
    keep: the terms that are wanted, where a scan answers one query."""
    named = (text,) if isinstance(text, str) else text
    source = rows.select(F.col(uid).alias("uid"), F.array(*[F.coalesce(F.col(c), F.lit("")) for c in named]).alias("texts"))

    kind = source.schema["uid"].dataType.simpleString()
    return source.mapInPandas(lambda batches: posting_frames(batches, keep), f"uid {kind}, term string, tf int, positions array<int>, length int")


def simple_postings(rows: DataFrame, uid: str, text: str) -> DataFrame:
    """The same without stemming, for ASCII letters and digits, all native."""
    terms = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    cut_ = rows.select(F.col(uid).alias("uid"), terms.alias("terms"))
    flat = cut_.select("uid", F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term"))
    found = flat.groupBy("uid", "term", "length").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("place")).alias("positions"))
    lengths = cut_.select("uid", F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"), F.array().cast("array<int>").alias("positions"), F.size("terms").alias("length"))
    return found.select("uid", "term", "tf", "positions", "length").unionAll(lengths)


@dataclass(frozen=True)
class Statistics:
    documents: int
    average: float


def statistics(index: DataFrame) -> Statistics:
    """Number of texts and their mean length; texts without terms count."""
    n, total = index.filter(F.col("term").isNull()).agg(F.count(F.lit(1)), F.sum("length")).first()
    return Statistics(n, (total or 0) / n if n else 0.0)


# ------------------------------------------------------------------ query language
@dataclass(frozen=True)
class Phrase:
    """Terms one after another; the last may be a prefix; first: at the text's start."""

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = NEAR_DISTANCE


@dataclass(frozen=True)
class Op:
    kind: str  # AND, OR, NOT
    left: object
    right: object


_SPECIAL = re.compile(r'["*():^+\-]|\b(?:AND|OR|NOT|NEAR)\b')
_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([():*^,+])|([^\s"():*^,+]+))')


def rewrite(query: str) -> str:
    """Plain words become quoted terms that must all occur; query syntax passes."""
    query = query.strip()
    if not query or _SPECIAL.search(query):
        return query
    return " ".join(f'"{t}"' for t in re.findall(r"[\w'’.&]+", query))


class _Parser:
    def __init__(self, query: str):
        self.tokens: list[str] = []
        at = 0
        query = query.rstrip()
        while at < len(query):
            m = _LEX.match(query, at)
            if not m:
                raise QuerySyntaxError(f"unexpected text at {query[at:]!r}")
            self.tokens.append(m[1] or m[2] or m[3])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        if self.peek() is None:
            raise QuerySyntaxError("the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self):
        tree = self.either()
        if self.peek() is not None:
            raise QuerySyntaxError(f"unexpected {self.peek()!r}")
        return tree

    def either(self):
        left = self.both()
        while self.peek() == "OR":
            self.take()
            left = Op("OR", left, self.both())
        return left

    def both(self):
        left = self.without()
        while self.peek() == "AND":
            self.take()
            left = Op("AND", left, self.without())
        return left

    def without(self):
        left = self.several()
        while self.peek() == "NOT":
            self.take()
            left = Op("NOT", left, self.several())
        return left

    def several(self):
        left = self.one()
        while (t := self.peek()) is not None and t not in (")", "OR", "AND", "NOT", ","):
            left = Op("AND", left, self.one())
        return left

    def one(self):
        t = self.take()
        if t == "(":
            tree = self.either()
            if self.take() != ")":
                raise QuerySyntaxError("a bracket is not closed")
            return tree
        if t == "NEAR" and self.peek() == "(":
            self.take()
            phrases, distance = [], NEAR_DISTANCE
            while self.peek() not in (")", ",", None):
                phrases.append(self.phrase(self.take()))
            if self.peek() == ",":
                self.take()
                if not (n := self.take()).isdigit():
                    raise QuerySyntaxError("NEAR needs a number")
                distance = int(n)
            if self.take() != ")" or not phrases:
                raise QuerySyntaxError("NEAR is not closed")
            return Near(tuple(phrases), distance)
        return self.phrase(t)

    def phrase(self, t: str) -> Phrase:
        column, first = None, False
        if self.peek() == ":":
            column = t
            self.take()
            t = self.take()
        if t == "^":
            first, t = True, self.take()
        words = self.words(t)
        prefix = False
        while self.peek() in ("+", "*"):
            if self.take() == "*":
                prefix = True
                break
            words += self.words(self.take())
        terms = tuple(words[:-1] and analyze(" ".join(words[:-1]))) + tuple([w for w in _prefix(words[-1])] if prefix and words else analyze(words[-1]) if words else ())
        return Phrase(terms, prefix, first, column)

    @staticmethod
    def words(t: str) -> list[str]:
        if t in ("(", ")", ":", ",", "^", "AND", "OR", "NOT"):
            raise QuerySyntaxError(f"unexpected {t!r}")
        text = t[1:-1].replace('""', '"') if t.startswith('"') else t
        return re.findall(r"[^\W_]+", text)


def _prefix(word: str) -> list[str]:
    from sextant.functions.porter import fold

    return re.findall(r"[^\W_]+", fold(word))


def parse(query: str):
    return _Parser(rewrite(query)).parse()


def leaves(tree, excluded: bool = False) -> list[Phrase]:
    """The phrases that score, or all that the query reads."""
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    return leaves(tree.left, excluded) + (leaves(tree.right, excluded) if excluded or tree.kind != "NOT" else [])


def terms_of(tree) -> Callable[[str], bool]:
    """Tells the terms that a query reads, those that it excludes too."""
    every = leaves(tree, excluded=True)
    whole = frozenset(t for p in every for t in (p.terms[:-1] if p.prefix else p.terms))
    starts = tuple(p.terms[-1] for p in every if p.prefix and p.terms)
    return lambda term: term in whole or term.startswith(starts)


# ------------------------------------------------------------------ evaluation
def _wanted(index: DataFrame, tree) -> DataFrame:
    """The postings of the query's terms: all that its evaluation reads."""
    hit = F.lit(False)
    for p in leaves(tree, excluded=True):
        whole = p.terms[:-1] if p.prefix else p.terms
        hit = (hit | F.col("term").isin(*whole)) if whole else hit
        hit = (hit | F.col("term").startswith(p.terms[-1])) if p.prefix and p.terms else hit
    return index.filter(hit)


def _starts(index: DataFrame, phrase: Phrase, columns: tuple[str, ...] = ()) -> DataFrame:
    """``uid, starts, length``: where the phrase occurs in each text.  A term has one
    row a text; only a prefix, which stands for many, is gathered."""
    out = None
    for k, term in enumerate(phrase.terms):
        if phrase.prefix and k == len(phrase.terms) - 1:
            here = index.filter(F.col("term").startswith(term)).groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("p"), F.max("length").alias("length"))
        else:
            here = index.filter(F.col("term") == term).select("uid", F.col("positions").alias("p"), "length")
        here = here.select("uid", F.transform("p", lambda x: x - k).alias("p"), "length")  # noqa: B023
        out = here if out is None else out.join(here.select("uid", F.col("p").alias("q")), "uid").select("uid", F.array_intersect("p", "q").alias("p"), "length")
    if out is None or (phrase.column is not None and phrase.column not in columns):
        return index.select("uid", F.array().cast("array<int>").alias("starts"), "length").limit(0)
    if phrase.column is not None:
        low = columns.index(phrase.column) * COLUMN
        out = out.select("uid", F.filter("p", lambda x: (x >= low) & (x < low + COLUMN)).alias("p"), "length")
    if phrase.first:
        out = out.select("uid", F.filter("p", lambda x: x % COLUMN == 0).alias("p"), "length")
    return out.filter(F.size("p") > 0).withColumnRenamed("p", "starts")


def unknown_columns(tree, columns: tuple[str, ...]) -> list[str]:
    """Columns that the query names and the index does not have."""
    return sorted({p.column for p in leaves(tree, excluded=True)} - {None, *columns})


def matching(index: DataFrame, tree, columns: tuple[str, ...] = ()) -> DataFrame:
    """``uid`` of the texts that the query matches."""
    if isinstance(tree, Phrase):
        return _starts(index, tree, columns).select("uid")
    if isinstance(tree, Near):
        found = None
        for k, phrase in enumerate(tree.phrases):
            one = _starts(index, phrase, columns).select("uid", F.transform("starts", lambda x: F.struct(x.alias("s"), (x + len(phrase.terms) - 1).alias("e"))).alias(f"w{k}"))  # noqa: B023
            found = one if found is None else found.join(one, "uid")
        near = F.lit(True)
        names = [f"w{k}" for k in range(len(tree.phrases))]
        if len(names) > 1:  # some occurrence of the first has one of each other close enough
            def close(a):
                ok = F.lit(True)
                for n in names[1:]:
                    ok = ok & F.exists(n, lambda b: F.greatest(b["s"] - a["e"], a["s"] - b["e"]) - 1 <= tree.distance)
                return ok

            near = F.exists(names[0], close)
        return found.filter(near).select("uid")
    left = matching(index, tree.left, columns)
    if tree.kind == "OR":
        return left.union(matching(index, tree.right, columns)).distinct()
    return left.join(matching(index, tree.right, columns), "uid", "left_semi" if tree.kind == "AND" else "left_anti")


def _idf(n: float, df: Column) -> Column:
    return F.greatest(F.when(F.lit(n) > df, F.ln((n - df + 0.5) / (df + 0.5))).otherwise(F.lit(MIN_IDF)), F.lit(MIN_IDF))


def _saturation(tf: Column, length: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25(index: DataFrame, tree, stats: Statistics, columns: tuple[str, ...] = ()) -> DataFrame:
    """``uid, score`` of the matching texts; negative, lower is better.  A phrase
    counts as one term.  The index is read once, for the query's terms; how many
    texts have each phrase is counted in the plan, not by the driver."""
    own = cut(_wanted(index, tree))
    parts = None
    for k, phrase in enumerate(dict.fromkeys(leaves(tree))):
        part = _starts(own, phrase, columns).select("uid", F.lit(k).alias("phrase"), F.size("starts").cast("double").alias("tf"), "length")
        parts = part if parts is None else parts.unionAll(part)
    parts = cut(parts)
    n, average = float(stats.documents), stats.average or 1.0
    counts = parts.groupBy("phrase").agg(F.count(F.lit(1)).cast("double").alias("df")).select("phrase", _idf(n, F.col("df")).alias("idf"))
    scored = parts.join(F.broadcast(counts), "phrase")  # a row per phrase of the query
    if not isinstance(tree, Phrase):
        scored = scored.join(matching(own, tree, columns), "uid", "left_semi")
    return scored.groupBy("uid").agg((-F.sum(F.col("idf") * _saturation(F.col("tf"), F.col("length"), average))).alias("score"))


PAGE_COLUMNS = ("text",)


@dataclass
class Index:
    """Postings of pages and of titles, with the tables they refer to.

    pages: page_uid, doc_id, page_no, text.  documents: id, title, and facets."""

    pages: DataFrame
    documents: DataFrame
    page_postings: DataFrame
    title_postings: DataFrame
    page_stats: Statistics
    title_stats: Statistics
    title_columns: tuple[str, ...] = ("title",)

    @staticmethod
    def build(pages: DataFrame, documents: DataFrame, title_columns: tuple[str, ...] = ("title", "filename", "author")) -> Index:
        held = tuple(c for c in title_columns if c in documents.columns)
        a, b = cut(postings(pages, "page_uid", "text")), cut(postings(documents, "id", held))
        return Index(pages, documents, a, b, statistics(a), statistics(b), held)

    def close(self) -> None:
        """Delete the postings; nothing reads the index after it."""
        drop(self.page_postings, self.title_postings)


@dataclass
class StoredIndex(Index):
    """An index in files.  blocks: term, block, n (texts that have it), best (the
    greatest part of a score, but for the term's weight, that it has in the block)."""

    blocks: DataFrame | None = None

    @staticmethod
    def write(path: str, pages: DataFrame, documents: DataFrame, title_columns: tuple[str, ...] = ("title", "filename", "author")) -> None:
        """Postings of both kinds, sorted by term and block over many files, so that the
        least and greatest term of a row group tell whether a query reads it."""
        spark = pages.sparkSession
        held = tuple(c for c in title_columns if c in documents.columns)
        for kind, found in (("pages", postings(pages, "page_uid", "text")), ("titles", postings(documents, "id", held))):
            texts = f"{path}/{kind}/all"
            found.write.parquet(texts)
            found = spark.read.parquet(texts)
            stats = statistics(found)
            n_blocks = max(1, -(-stats.documents // BLOCK_TEXTS))
            block = F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("int")
            ordered = found.filter("term is not null").withColumn("block", block).repartitionByRange("term", "block").sortWithinPartitions("term", "block", "uid")
            ordered.write.option("parquet.block.size", 1 << 20).parquet(f"{path}/{kind}/postings")
            kept = spark.read.parquet(f"{path}/{kind}/postings")
            best = F.max(_saturation(F.col("tf").cast("double"), F.col("length"), stats.average or 1.0))
            kept.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/{kind}/blocks")
            spark.createDataFrame([(stats.documents, stats.average, ",".join(held))], "documents bigint, average double, columns string").coalesce(1).write.parquet(f"{path}/{kind}/stats")
            _delete(spark, texts)

    @staticmethod
    def open(path: str, pages: DataFrame, documents: DataFrame) -> StoredIndex:
        read = pages.sparkSession.read.parquet
        a, b = read(f"{path}/pages/stats").first(), read(f"{path}/titles/stats").first()
        return StoredIndex(
            pages, documents, read(f"{path}/pages/postings"), read(f"{path}/titles/postings"), Statistics(a[0], a[1]), Statistics(b[0], b[1]), tuple(b[2].split(",")), read(f"{path}/pages/blocks")
        )

    def close(self) -> None:
        pass


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _single_terms(tree) -> bool:
    """The query's phrases are all one whole term, anywhere in a text."""
    return not isinstance(tree, Near) and (len(tree.terms) == 1 and not (tree.prefix or tree.first or tree.column) if isinstance(tree, Phrase) else _single_terms(tree.left) and _single_terms(tree.right))


def _holds(tree, has: Column) -> Column:
    """The query of single terms, of a text with these terms."""
    if isinstance(tree, Phrase):
        return F.array_contains(has, tree.terms[0])
    left, right = _holds(tree.left, has), _holds(tree.right, has)
    return left | right if tree.kind == "OR" else left & right if tree.kind == "AND" else left & ~right


def _may_hold(tree, has: Column) -> Column:
    """Whether a block with these terms can have a text that the query matches."""
    if isinstance(tree, Phrase):
        return F.array_contains(has, tree.terms[0])
    if tree.kind == "NOT":
        return _may_hold(tree.left, has)
    left, right = _may_hold(tree.left, has), _may_hold(tree.right, has)
    return left | right if tree.kind == "OR" else left & right


def top_pages(index: StoredIndex, query: str, k: int) -> DataFrame:
    """The first k hits, ``doc_id, page_no, page_uid, score`` in order of relevance and
    page_uid, equal to those of ``search_pages``.

    A block's texts score at most the sum of its terms' best.  The blocks of highest
    bounds are scored first; the k-th score found there rules out every block whose
    bound is lower, and only the others are read.  Queries with phrases, prefixes or
    NEAR go to ``search_pages``, as their parts have no stored weight."""
    tree = parse(query)
    if not _single_terms(tree):
        return search_pages(index, query, k)
    scoring = {p.terms[0] for p in leaves(tree)}
    terms = sorted({p.terms[0] for p in leaves(tree, excluded=True)})
    blocks = cut(index.blocks.filter(F.col("term").isin(*terms)))
    weights = blocks.groupBy("term").agg(F.sum("n").cast("double").alias("df")).select("term", F.when(F.col("term").isin(*scoring), _idf(float(index.page_stats.documents), F.col("df"))).otherwise(0.0).alias("idf"))
    weights = F.broadcast(cut(weights))  # a row per term of the query
    bounds = blocks.join(weights, "term").groupBy("block").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"), F.collect_set("term").alias("has"))
    bounds = cut(bounds.filter(_may_hold(tree, F.col("has"))).select("block", "bound"))

    def scored(some: DataFrame) -> DataFrame:
        own = index.page_postings.filter(F.col("term").isin(*terms)).join(some.select("block"), "block", "left_semi").join(weights, "term")
        part = F.col("idf") * _saturation(F.col("tf").cast("double"), F.col("length"), index.page_stats.average or 1.0)
        found = own.groupBy("uid").agg((-F.sum(part)).alias("score"), F.collect_set("term").alias("has"))
        return found.filter(_holds(tree, F.col("has"))).select("uid", "score")

    first = scored(bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS * k)).orderBy("score", "uid").limit(k)
    reached = first.agg(F.count(F.lit(1)), F.max("score")).first()
    rest = bounds if reached[0] < k else bounds.filter(F.col("bound") >= -reached[1] - 1e-9)
    hits = scored(rest).withColumnRenamed("uid", "page_uid").orderBy("score", "page_uid").limit(k)
    return hits.join(index.pages.select("page_uid", "doc_id", "page_no"), "page_uid").orderBy("score", "page_uid")


def search_pages(index: Index, query: str, limit: int | None = None) -> DataFrame:
    """``doc_id, page_no, page_uid, score`` in order of relevance.  A query that names a
    column which pages do not have matches none."""
    tree = parse(query)
    hits = bm25(index.page_postings, tree, index.page_stats, PAGE_COLUMNS).withColumnRenamed("uid", "page_uid")
    if unknown_columns(tree, PAGE_COLUMNS):
        hits = hits.limit(0)
    out = hits.join(index.pages.select("page_uid", "doc_id", "page_no"), "page_uid")
    return out.orderBy("score", "page_uid").limit(limit) if limit else out


def search_titles(index: Index, query: str) -> DataFrame:
    """``doc_id, score`` of the documents whose title, file name or author match."""
    tree = parse(query)
    hits = bm25(index.title_postings, tree, index.title_stats, index.title_columns)
    return (hits.limit(0) if unknown_columns(tree, index.title_columns) else hits).withColumnRenamed("uid", "doc_id")


def search(index: Index, query: str, facets: dict[str, str] | None = None, year_from: int | None = None, year_to: int | None = None, mentions: DataFrame | None = None, entity: int | None = None, entity2: int | None = None, page_cap: int | None = None) -> DataFrame:
    """Documents with score (lower is better), pages and title_hit.

    Text hits add up over pages, title hits count three times.  With a text query
    entities restrict it; without one the first entity's documents are the hits,
    scored by their mentions, and a second entity restricts those.  ``*`` or an
    empty query without entities lists all documents.  Filters on documents come
    before scores are joined to them; page_cap keeps only so many page hits."""
    text = query.strip() not in ("", "*")
    docs = filter_documents(index.documents, facets, year_from, year_to)
    hits = None
    if text:
        found = search_pages(index, query, page_cap)
        body = found.groupBy("doc_id").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("page_no")).alias("pages"), F.lit(False).alias("title"))
        title = search_titles(index, query).select("doc_id", (TITLE_WEIGHT * F.col("score")).alias("score"), F.array().cast("array<int>").alias("pages"), F.lit(True).alias("title"))
        hits = body.unionByName(title).groupBy("doc_id").agg(F.sum("score").alias("score"), F.array_sort(F.flatten(F.collect_list("pages"))).alias("pages"), F.max("title").alias("title_hit"))
    for k, e in enumerate((entity, entity2)):
        if e is None:
            continue
        own = mentions.filter(F.col("entity_id") == e).groupBy("doc_id").agg((-F.sum("count")).cast("double").alias("score"))
        if text or (k == 1 and entity is not None):
            hits = hits.join(own.select("doc_id"), "doc_id", "left_semi")
        else:
            hits = own.select("doc_id", "score", F.array().cast("array<int>").alias("pages"), F.lit(False).alias("title_hit"))
    if hits is None:
        hits = docs.select(F.col("id").alias("doc_id"), F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("pages"), F.lit(False).alias("title_hit"))
    return hits.join(docs.withColumnRenamed("id", "doc_id"), "doc_id")


def malformed_udf():
    """Whether a query does not parse, over Arrow batches; null does."""

    def bad(query: str | None) -> bool:
        try:
            parse(query or "*")
        except QuerySyntaxError:
            return query is not None and query.strip() not in ("", "*")
        return False

    return F.pandas_udf(lambda s: s.map(bad), "boolean")


def safe_search(index: Index, query: str, **filters) -> tuple[DataFrame, str | None]:
    """``search`` and a message: no rows for a query that does not parse, the titles' hits
    for one that names a column which pages do not have."""
    try:
        found = search(index, query, **filters)
        missing = unknown_columns(parse(query), PAGE_COLUMNS) if query.strip() not in ("", "*") else []
        return found, f"Search syntax error: no such column: {', '.join(missing)}" if missing else None
    except QuerySyntaxError as e:
        return search(index, "*", **{k: v for k, v in filters.items() if k in ("facets", "year_from", "year_to")}).limit(0), f"Search syntax error: {e}"


def search_all(results: DataFrame, per_corpus: int = 5, cap: int = 10_000) -> DataFrame:
    """Top results of each corpus and its total (capped).  results: corpus_id, doc_id, score."""
    rank = F.row_number().over(Window.partitionBy("corpus_id").orderBy("score", "doc_id"))
    total = F.least(F.count(F.lit(1)).over(Window.partitionBy("corpus_id")), F.lit(cap))
    return results.withColumn("rank", rank).withColumn("total", total).filter(F.col("rank") <= per_corpus)


def snippets(hits: DataFrame, query: str, width: int = 28, per_doc: int = 3, start: str = "[[[", end: str = "]]]") -> DataFrame:
    """``doc_id, page_no, snippet`` of each document's first pages.  hits: doc_id,
    page_no, text, score; only these few rows reach Python."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("score", "page_no"))
    top = hits.withColumn("rank", rank).filter(F.col("rank") <= per_doc).select("doc_id", "page_no", "text")
    terms = {t for p in leaves(parse(query)) for t in p.terms}

    def cut(text: str) -> str:
        words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
        hit = [bool(terms.intersection(analyze(w))) for w, _, _ in words]
        if not words:
            return ""
        best = max(range(max(1, len(words) - width + 1)), key=lambda k: (sum(hit[k : k + width]), -k))
        out, at = "… " if best else "", words[best][1]
        stop = min(len(words), best + width)
        for k in range(best, stop):
            w, a, b = words[k]
            out += text[at:a] + (start + w + end if hit[k] else w)
            at = b
        return out + (" …" if stop < len(words) else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "page_no": b["page_no"], "snippet": [cut(t or "") for t in b["text"]]})

    return top.mapInPandas(run, f"doc_id {top.schema['doc_id'].dataType.simpleString()}, page_no int, snippet string")
