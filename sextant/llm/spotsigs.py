"""Spot signatures of documents (SpotSigs), compared by pruned Jaccard similarity.

A signature is a common word, the anchor, with the content words that follow it.
Boilerplate has few common words in running text, so the set of a document's
signatures says what its prose is about.  Everything is a Column expression.

Sets are partitioned by length on a scale of powers: two sets can reach a
similarity only if the smaller has that share of the larger's signatures, so only
sets of the same or neighbouring partitions are compared at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.common import let, words_of
from sextant.llm.quality import STOP_WORDS

#: Words after an anchor among which the second word of its chain is looked for.
REACH = 8
#: Similarity below which two sets count as unlike.
LEAST = 0.1
#: Hex digits of a signature.
DIGITS = 12
#: Documents that one bucket of the order holds at first; buckets at most, beyond which they grow.
BUCKET_ROWS, BUCKETS = 2_000, 4_096


def signatures(text: Column, anchors: list[str] | tuple[str, ...] = tuple(STOP_WORDS)) -> Column:
    """The sorted set of a text's spot signatures, each DIGITS hex digits of an MD5.

    Anchors are common words right before a content word, upper and lower case
    alike; its chain is that word and the next content word of the REACH words after it.  In
    a text that has no such place every word is an anchor.  A null text is empty, and
    a text without a word has no signature.
    """

    def hashed(*parts: Column) -> Column:
        return F.substring(F.md5(F.concat_ws(" ", *parts).cast("binary")), 1, DIGITS)

    def of(words: Column) -> Column:
        content = F.transform(words, lambda w: F.when(~w.isin(*anchors), w))

        def spots(c: Column) -> Column:
            places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(c, i).isNull() & F.get(c, i + 1).isNotNull())
            second = lambda i: F.coalesce(*[F.get(c, i + k) for k in range(2, REACH + 1)])
            every = F.transform(words, lambda w, i: hashed(w, F.get(words, i + 1), F.get(words, i + 2)))
            return let(places, lambda p: F.when(F.size(p) > 0, F.transform(p, lambda i: hashed(words[i], c[i + 1], second(i)))).otherwise(every))

        return F.when(F.size(words) > 0, let(content, spots)).otherwise(F.array().cast("array<string>"))

    return F.sort_array(F.array_distinct(let(words_of(F.lower(text)), of)))


def fingerprint(found: Column) -> Column:
    """A set of signatures as one string."""
    return F.array_join(found, "")


def partition(found: Column, least: float = LEAST) -> Column:
    """The set's partition by length: powers of 1/least; of the empty set -1."""
    return F.when(F.size(found) == 0, -1).otherwise(F.floor(F.log(F.size(found).cast("double")) / F.lit(-math.log(least)) + 1e-9)).cast("int")


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard similarity of two sets of signatures, zero if it is below ``least``.
    Two empty sets are alike (1).

    Sets whose partitions are not the same or neighbours are not compared, nor are
    those whose lengths already rule the similarity out."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    reachable = (F.abs(partition(a, least) - partition(b, least)) <= 1) & (small >= F.lit(least) * large)
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(large == 0, 1.0).when(small == 0, 0.0).when(a == b, 1.0).when(~reachable, 0.0).otherwise(let(both, lambda x: F.when(x >= least, x).otherwise(0.0)))


def with_next(docs: DataFrame, derived: dict[str, Column], columns: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with columns ``derived`` from it, and the next row's values of ``columns``
    (its own or derived) as ``next_<column>``, by ascending id, after the last the first.  A null id comes first; rows that repeat an
    id follow each other by a hash of their texts.

    No task sorts all rows: ids are cut into buckets at percentiles, an id that fills
    several by the hash, and every bucket's first row also ends the one before it.
    """
    order = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    mark = F.xxhash64(F.col(text_col).cast("binary"))
    count = docs.count()
    n = max(1, min(BUCKETS, -(-count // BUCKET_ROWS)))
    cuts = docs.agg(F.percentile_approx(order, [k / n for k in range(1, n)], 10 * BUCKETS)).first()[0] or [] if n > 1 else []
    keyed = docs.withColumn("w_order", order).withColumn("w_mark", mark).withColumn("w_bucket", _bucket(F.col("w_order"), F.col("w_mark"), cuts))
    firsts = keyed.groupBy("w_bucket").agg(F.min(F.struct("w_order", "w_mark")).alias("w_first"))
    everywhere = Window.orderBy("w_bucket")  # a row per bucket
    before = F.coalesce(F.lag("w_bucket").over(everywhere), F.max("w_bucket").over(Window.partitionBy()))
    ends = firsts.select(F.col("w_bucket").alias("e_bucket"), F.col("w_first.w_order").alias("e_order"), F.col("w_first.w_mark").alias("e_mark"), before.alias("e_before"))
    same = (F.col("w_bucket") == F.col("e_bucket")) & (F.col("w_order") == F.col("e_order")) & (F.col("w_mark") == F.col("e_mark"))
    closing = keyed.join(F.broadcast(ends), same).withColumn("w_bucket", F.col("e_before")).drop("e_bucket", "e_order", "e_mark", "e_before")  # at most BUCKETS rows
    rows = keyed.withColumn("w_closing", F.lit(False)).unionByName(closing.withColumn("w_closing", F.lit(True)))
    following = Window.partitionBy("w_bucket").orderBy("w_closing", "w_order", "w_mark")
    out = rows.withColumns(derived).select("*", *[F.lead(c).over(following).alias(f"next_{c}") for c in columns]).filter(~F.col("w_closing"))
    return out.drop("w_bucket", "w_order", "w_mark", "w_closing")


def _bucket(order: Column, mark: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the value, found by halving; rows of a value that
    fills several buckets are dealt to these by their mark, in order of it."""
    if not cuts:
        return F.lit(0)
    values = F.lit([*cuts])
    size = 1 << len(cuts).bit_length()
    steps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())])
    last = len(cuts)

    def below(than: int) -> Column:
        """Cuts below the value (than 0), or at or below it (than 1)."""

        def step(at: Column, s: Column) -> Column:
            cut = values[F.least(at + s, F.lit(last)) - 1]
            return F.when((at + s <= last) & ((cut <= order) if than else (cut < order)), at + s).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    share = (mark.cast("double") / 2.0**64 + 0.5).cast("double")
    low, high = below(0), below(1)
    return let(low, lambda a: let(high, lambda b: F.when(b - a > 1, F.least(b - 1, a + F.floor(share * (b - a)).cast("int")) + 1).otherwise(b)))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document beside its edited text: ``doc_id, n_chars, text, edited, found,
    next_found, edited_found``, the last three the sets of signatures of the text, the
    next text and the edited text.

    Edited: the last quarter of the characters replaced by as many first ones of the
    next document (all, if it has fewer).  A null text is empty.  Rows stay as they are
    repeated; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, {"found": signatures(F.col("text"))}, ["text", "found"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"), "found", F.col("next_found"))
    return rows.withColumn("edited_found", signatures(F.col("edited")))
