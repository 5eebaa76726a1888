"""Mixing sources to target weights, by hierarchical budgeting.

A token budget runs down a tree domain -> language -> source.  At each node the
children share its budget by weight; a child that cannot use its share (all its
tokens, max_epochs times) leaves the shortage to its siblings.  A node's budget
never exceeds what its subtree holds, so a shortage reaches an ancestor's
siblings only when all of its own are exhausted.  Each leaf then takes whole
epochs and a token prefix of one more, in an order seeded by the epoch.

Everything is DataFrame expressions: one narrow pass, aggregates with map-side
sums, and windows over nodes or over one of 4,096 slices of a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.common import materialise, release, words_of

#: Stands for a null language or source in the tree.
NONE = "(none)"
#: A leaf's order has 60 bits; their first 12 number its slices.
KEY_BITS, SLICE_BITS = 60, 12
#: Tables of a row per leaf are broadcast up to this many leaves, counted first;
#: beyond it they are joined by shuffles, whose hot leaves adaptive execution splits.
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Mixture:
    """Weights are whole numbers from 0 (left out) to 10,000, relative to siblings.

    domains: domain of each source; other sources are in ``other``.
    domain_weights; language_weights and source_weights: by domain, then name.
    What is not listed has weight ``default``.  budget: the target as a fraction
    of the tokens there are, as numerator and denominator.
    """

    domains: dict[str, str]
    domain_weights: dict[str, int]
    language_weights: dict[str, dict[str, int]] = field(default_factory=dict)
    source_weights: dict[str, dict[str, int]] = field(default_factory=dict)
    default: int = 1
    other: str = "other"
    budget: tuple[int, int] = (9, 10)
    max_epochs: int = 4
    seed: str = "mix-1"


def _numbered(first: int, last: int) -> list[str]:
    return [f"src{k}" for k in range(first, last + 1)]


#: The production mixture: src0 is one very large crawl.
PRODUCTION = Mixture(
    domains={s: d for d, names in (("crawl", ["src0"]), ("web", _numbered(1, 9)), ("books", _numbered(10, 13)), ("reference", _numbered(14, 16))) for s in names},
    domain_weights={"crawl": 30, "web": 40, "books": 20, "reference": 15, "other": 5},
    language_weights={d: {"en": 50, "de": 20, "fr": 20, "es": 25} for d in ("crawl", "web", "books", "reference", "other")},
    source_weights={"web": {"src1": 3, "src2": 2}, "books": {"src10": 4}},
)


def _lookup(table: dict[str, int], name: Column, default: int) -> Column:
    if not table:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(pairs[name], F.lit(default))


def _nested(tables: dict[str, dict[str, int]], domain: Column, name: Column, default: int) -> Column:
    out = F.lit(default)
    for d, table in tables.items():
        out = F.when(domain == d, _lookup(table, name, default)).otherwise(out)
    return out


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Children's shares of their parent's budget, as column ``share``.

    nodes: the parent's columns, name, weight, capacity and budget.  In order of
    capacity over weight, a child is full if filling all to its level takes no
    more than the budget; the others divide by weight what the full ones leave.
    """
    big = lambda c: F.col(c).cast("decimal(20,0)")
    small = lambda c: F.col(c).cast("decimal(9,0)")
    nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0).cast("bigint")))
    level = F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight")).otherwise(0.0)
    own = Window.partitionBy(*parent)
    upto = own.orderBy("level", name).rowsBetween(Window.unboundedPreceding, 0)
    rows = nodes.withColumn("level", level).withColumn("up_capacity", F.sum("capacity").over(upto)).withColumn("up_weight", F.sum("weight").over(upto))
    rows = rows.withColumn("all_weight", F.sum("weight").over(own))
    full = big("up_capacity") * small("weight") + big("capacity") * (F.col("all_weight") - F.col("up_weight")).cast("decimal(9,0)") <= big("budget") * small("weight")
    rows = rows.withColumn("full", full)
    rows = rows.withColumn("taken", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(own))
    rows = rows.withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(own))
    part = F.expr("cast(weight as decimal(9,0)) * cast(budget - taken as decimal(20,0)) div cast(open as decimal(9,0))")
    return rows.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(part)).select(*parent, name, "share")


def allocate(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """``share`` tokens of every leaf: domain, lang, source, tokens, share."""
    domain, lang = F.col("domain"), F.col("lang")
    weighted = leaves.select(
        "domain", "lang", "source", "tokens",
        F.lit(0).alias("root"),
        _lookup(mixture.domain_weights, domain, mixture.default).cast("bigint").alias("w_domain"),
        _nested(mixture.language_weights, domain, lang, mixture.default).cast("bigint").alias("w_lang"),
        _nested(mixture.source_weights, domain, F.col("source"), mixture.default).cast("bigint").alias("w_source"),
    )
    usable = (F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0)
    weighted = weighted.withColumn("capacity", F.when(usable, F.col("tokens") * mixture.max_epochs).otherwise(F.lit(0).cast("bigint")))
    top, bottom = mixture.budget
    target = weighted.groupBy("root").agg(F.expr(f"cast(sum(tokens) as decimal(20,0)) * {int(top)} div {int(bottom)}").alias("budget"))
    domains = weighted.groupBy("root", "domain").agg(F.max("w_domain").alias("weight"), F.sum("capacity").alias("capacity"))
    d = _share(domains.join(target, "root"), ["root"], "domain").select("domain", F.col("share").alias("budget"))
    langs = weighted.groupBy("domain", "lang").agg(F.max("w_lang").alias("weight"), F.sum("capacity").alias("capacity"))
    g = _share(langs.join(d, "domain"), ["domain"], "lang").withColumnRenamed("share", "budget")
    sources = weighted.select("domain", "lang", "source", F.col("w_source").alias("weight"), "capacity")
    s = _share(sources.join(g, ["domain", "lang"]), ["domain", "lang"], "source")
    return leaves.join(s, ["domain", "lang", "source"]).select("domain", "lang", "source", "tokens", "share")


def order_key(seed: str, epoch: Column, doc_id: Column) -> Column:
    """60 bits that order a leaf's documents in an epoch."""
    text = F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(NONE)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def _leaf_columns(mixture: Mixture, id_col: str, lang_col: str, source_col: str) -> list[Column]:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(NONE))
    pairs = F.create_map(*[F.lit(x) for pair in mixture.domains.items() for x in pair]) if mixture.domains else None
    domain = F.coalesce(pairs[source], F.lit(mixture.other)) if pairs is not None else F.lit(mixture.other)
    return [domain.alias("domain"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)).alias("lang"), source.alias("source"), F.col(id_col).alias("m_id")]


def _small(df: DataFrame, leaves: int) -> DataFrame:
    """df, of at most one row per leaf, to be broadcast if the leaves are few enough."""
    return F.broadcast(df) if leaves <= BROADCAST_LEAVES else df


def cutoffs(rows: DataFrame, shares: DataFrame, mixture: Mixture, leaves: int = BROADCAST_LEAVES + 1) -> DataFrame:
    """For each leaf: its whole epochs, and the last key of the prefix that the
    next epoch adds (-1: none).  Documents of equal key are taken together."""
    leaf = ["domain", "lang", "source"]
    some = F.col("tokens") > 0
    plan = shares.select(*leaf, F.when(some, F.expr("share div tokens")).otherwise(F.lit(0).cast("bigint")).alias("epochs"), F.when(some, F.col("share") % F.col("tokens")).otherwise(F.lit(0).cast("bigint")).alias("rest"))
    keyed = rows.join(_small(plan.filter("rest > 0"), leaves), leaf).withColumn("key", order_key(mixture.seed, F.col("epochs"), F.col("m_id")))
    keyed = keyed.withColumn("slice", F.shiftright("key", KEY_BITS - SLICE_BITS))
    sums = keyed.groupBy(*leaf, "rest", "slice").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*leaf).orderBy("slice")) - F.col("n")
    edge = sums.withColumn("before", before).filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    edge = edge.select(*leaf, "slice", "before")
    running = F.sum("n_tokens").over(Window.partitionBy(*leaf).orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    inside = keyed.join(_small(edge, leaves), [*leaf, "slice"]).withColumn("upto", F.col("before") + running).filter(F.col("upto") <= F.col("rest"))
    last = inside.groupBy(*leaf).agg(F.max("key").alias("last"))
    start = F.shiftleft(F.col("slice").cast("bigint"), KEY_BITS - SLICE_BITS) - 1
    cut = plan.join(edge.select(*leaf, "slice"), leaf, "left").join(last, leaf, "left")
    return cut.select(*leaf, "epochs", F.coalesce("last", start, F.lit(-1).cast("bigint")).alias("cutoff"))


def mix(docs: DataFrame, mixture: Mixture = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """The chosen documents, once per epoch: ``doc_id, domain, lang, source,
    n_tokens, epoch`` and the columns named in carry as ``c_0, c_1, ...`` (with
    these, texts are not split again and n_tokens is null).

    A token is a word.  A prefix takes documents in order of the epoch's key as
    long as their tokens fit what the leaf has left, so no leaf exceeds its share.
    Null languages and sources are nodes named ``(none)``; a null text has no
    tokens.  Rows that repeat an id have equal keys and are taken together.
    Documents without tokens follow their keys like others.
    """
    node = _leaf_columns(mixture, id_col, lang_col, source_col)
    rows = materialise(docs.select(*node, F.size(words_of(F.col(text_col))).cast("bigint").alias("n_tokens")), "mix-rows")
    leaf = ["domain", "lang", "source"]
    leaves = materialise(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    shares = materialise(allocate(leaves, mixture), "mix-shares")
    n_leaves = shares.count()
    cuts = materialise(cutoffs(rows, shares, mixture, n_leaves), "mix-cuts")
    release(leaves, shares)
    if carry:
        release(rows)
        rows = docs.select(*node, F.lit(None).cast("bigint").alias("n_tokens"), *[F.col(c).alias(f"c_{k}") for k, c in enumerate(carry)])
    key = order_key(mixture.seed, F.col("epochs"), F.col("m_id"))
    times = (F.col("epochs") + F.when(key <= F.col("cutoff"), 1).otherwise(0)).cast("int")
    chosen = rows.join(_small(cuts, n_leaves), leaf).withColumn("times", times).filter("times > 0")
    out = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return out.select(F.col("m_id").alias("doc_id"), *leaf, "n_tokens", "epoch", *[f"c_{k}" for k in range(len(carry))])
