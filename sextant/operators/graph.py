"""Subgraphs, ego networks and graph measures over edge tables (src, dst, docs, npmi)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.scratch import TASK_ROWS, cut, drop, is_cut, spread


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge seen from each of its ends: node, other, and the edge's columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *rest).unionAll(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *rest))


def neighbours(edges: DataFrame, node: int, entities: DataFrame | None = None) -> DataFrame:
    """The node's neighbours with the edge's columns (and name and type)."""
    near = both_ways(edges.filter((F.col("src") == node) | (F.col("dst") == node))).filter(F.col("node") == node).drop("node")
    return near if entities is None else near.join(entities.select(F.col("id").alias("other"), "name", "type"), "other")


def top_neighbours(near: DataFrame, per_type: int = 12) -> DataFrame:
    """The strongest neighbours of each type, by documents, then id."""
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("docs"), "other"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= per_type)


def distinctive_neighbours(near: DataFrame, min_docs: int = 3, limit: int = 20) -> DataFrame:
    return near.filter(F.col("docs") >= min_docs).orderBy(F.desc("npmi"), F.desc("docs"), "other").limit(limit)


def induced(edges: DataFrame, nodes: DataFrame, min_docs: int = 1) -> DataFrame:
    """Edges with both ends among nodes (column id) and enough documents."""
    a, b = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
    return edges.filter(F.col("docs") >= min_docs).join(a, "src", "left_semi").join(b, "dst", "left_semi").select(*edges.columns)


def strongest_links(edges: DataFrame, k: int, weight: str = "docs") -> DataFrame:
    """Edges among the k strongest of at least one of their ends; ties: smaller (src, dst).
    Edges are written once, for both passes, and dealt by their number."""
    edges = edges if is_cut(edges) else cut(edges)
    n = edges.count()
    ends = spread(edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("node"), F.col(weight).alias("w")), 2 * n, "node")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "src", "dst"))
    kept = ends.withColumn("rank", rank).filter(F.col("rank") <= k).select("src", "dst").distinct()
    return spread(edges, n, "src", "dst").join(kept, ["src", "dst"], "left_semi").select(*edges.columns)


def node_filter(entities: DataFrame, types: list[str] | None = None, min_docs: int = 0, max_docs: int | None = None, hide_auto: bool = False) -> DataFrame:
    out = entities.filter(F.col("doc_count") >= min_docs)
    if types:
        out = out.filter(F.col("type").isin(*types))
    if max_docs is not None:
        out = out.filter(F.col("doc_count") <= max_docs)
    return out.filter(F.col("auto") == 0) if hide_auto else out


def connected(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that some edge touches."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return entities.join(ends, "id", "left_semi")


def top_subgraph(entities: DataFrame, edges: DataFrame, limit: int, min_docs: int, k: int) -> DataFrame:
    """Links among the most documented entities, thinned to each node's k strongest."""
    nodes = entities.orderBy(F.desc("doc_count"), "id").limit(limit)
    return strongest_links(induced(edges, nodes, min_docs), k)


def ego_network(edges: DataFrame, focus: int, limit: int, metric: str = "docs", min_docs: int = 1) -> DataFrame:
    """The focus' links to its strongest neighbours, and the links among those."""
    near = neighbours(edges.filter(F.col("docs") >= min_docs), focus).orderBy(F.desc(metric), "other").limit(limit)
    nodes = near.select(F.col("other").alias("id")).unionAll(edges.sparkSession.range(1).select(F.lit(focus).cast(edges.schema["src"].dataType).alias("id")))
    return induced(edges, nodes, min_docs)


def relation_graph(relations: DataFrame, entities: DataFrame, limit: int, k: int) -> DataFrame:
    """The relation variant of the top subgraph: only connected nodes, weight by documents."""
    from sextant.operators.relations import undirected

    links = undirected(relations)
    return top_subgraph(connected(entities, links), links, limit, 1, k)


def leads(edges: DataFrame, entities: DataFrame, min_docs: int = 2, limit: int = 30, types: tuple[str, str] | None = None) -> DataFrame:
    """The most distinctive pairs; types: one end of each, in either order."""
    e = entities.select("id", "name", "type")
    a = e.select(F.col("id").alias("src"), F.col("name").alias("src_name"), F.col("type").alias("src_type"))
    b = e.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.col("type").alias("dst_type"))
    out = edges.filter(F.col("docs") >= min_docs).join(a, "src").join(b, "dst")
    if types:
        x, y = types
        s, d = F.col("src_type"), F.col("dst_type")
        out = out.filter(((s == x) & (d == y)) | ((s == y) & (d == x)))
    out = out.orderBy(F.desc("npmi"), F.desc("docs"), "src", "dst").limit(limit)
    return out.select("src", "dst", "src_name", "dst_name", "docs", "npmi")


def analysis_graph(entities: DataFrame, edges: DataFrame, max_df: int, limit: int | None = 3000, min_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes and links for graph measures: hubs out, the top entities (all, if limit is
    None), well supported links, isolated nodes dropped."""
    nodes = entities.filter(F.col("doc_count") <= max_df)
    if limit is not None:
        nodes = nodes.orderBy(F.desc("doc_count"), "id").limit(limit)
    links = cut(induced(edges, nodes, min_docs))
    return connected(nodes, links), links


def pagerank(edges: DataFrame, weight: str = "docs", damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """Weighted PageRank of a directed graph, rounds fixed: ``node, rank``.  Each
    round is a join on the source and a sum by target; what dangling nodes hold is
    spread evenly.  Rounds are checkpointed.

    Nodes that nothing links to all have one rank, known before a round: what they give
    a target is that rank times a sum over their links, taken once.  So a round goes
    over the links of the other nodes only."""
    e = cut(edges.select("src", "dst", F.col(weight).cast("double").alias("w")))
    links = e.count()
    dealt = spread(e, links, "src")
    out = dealt.groupBy("src").agg(F.sum("w").alias("total"))
    fed = e.filter("src is not null and w is not null").select(F.col("dst").alias("src")).distinct().withColumn("fed", F.lit(True))
    share = cut(dealt.join(out, "src").join(fed, "src", "left").select("src", "dst", (F.col("w") / F.col("total")).alias("p"), F.coalesce("fed", F.lit(False)).alias("fed")))
    nodes = cut(share.select(F.col("src").alias("node")).union(share.select("dst")).distinct())
    n = nodes.count()
    first = cut(share.filter("not fed").groupBy("dst").agg(F.sum("p").alias("p")))
    live = cut(spread(share.filter("fed").select("src", "dst", "p"), links, "src"))
    moving = not live.isEmpty()
    base = 1.0 / max(1, n)
    ranks = nodes.withColumn("rank", F.lit(base))
    for _ in range(rounds if n else 0):
        sent = first.select("dst", (F.lit(base) * F.col("p")).alias("in"))
        if moving:
            sent = sent.unionAll(ranks.join(live, ranks["node"] == live["src"]).select("dst", F.col("rank") * F.col("p")))
        given = cut(sent.groupBy("dst").agg(F.sum("in").alias("in")))
        loose = 1 - (given.agg(F.sum("in")).first()[0] or 0.0)
        base = (1 - damping + damping * loose) / n
        ranks = nodes.join(given, nodes["node"] == given["dst"], "left").select("node", (F.lit(base) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
    return ranks


#: Shortest paths are counted in groups: a component's links with so many of its sources.
GROUP_SOURCES = 1_000
#: Components of more links (each counted from both ends) than a group should hold go by joins.
GROUP_LINKS = 4_000_000
#: Links looked at, sources x links, by a task; and by one batch of sources of the joins.
TASK_STEPS, BATCH_STEPS = 20_000_000, 200_000_000


def _components(near: DataFrame) -> DataFrame:
    """``node, root`` of links a, b (each from both ends): root is the smallest node that
    can be reached.  Alternating stars: larger neighbours move to a node's smallest one,
    then smaller ones do, until nothing moves."""
    now, mark = cut(near.filter("a > b").select("a", "b")), None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, cut(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        drop(last)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select("b", "b").distinct())
        mark = new


def _dependencies(a: np.ndarray, b: np.ndarray, sources: np.ndarray, steps: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Brandes' sums over the sources of a component: its nodes and what they are owed.
    Links a, b stand from both ends; about ``steps`` of them are looked at together."""
    ids = np.unique(a)
    n, src = len(ids), np.searchsorted(ids, a)
    dst = np.searchsorted(ids, b)
    order = np.lexsort((dst, src))
    dst, first = dst[order], np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    del src, order
    owed_by_all, picked = np.zeros(n), np.searchsorted(ids, np.sort(sources))
    each = max(1, steps // max(1, len(dst)))
    for k in range(0, len(picked), each):
        roots = picked[k : k + each]
        at = np.arange(len(roots)) * n + roots  # a source's nodes lie side by side
        seen, paths, owner = np.zeros(len(roots) * n, bool), np.zeros(len(roots) * n), np.empty(len(roots) * n, np.int64)
        seen[at], paths[at], start, down = True, 1.0, at, []
        while len(at):
            v = at % n
            degree = first[v + 1] - first[v]
            link = np.arange(degree.sum()) + np.repeat(first[v] - np.cumsum(degree) + degree, degree)
            head, tail = np.repeat(at, degree), np.repeat(at - v, degree) + dst[link]
            new = ~seen[tail]
            head, tail = head[new], tail[new]
            np.add.at(paths, tail, paths[head])
            place = np.arange(len(tail))
            owner[tail] = place
            at = tail[owner[tail] == place]
            seen[at] = True
            down.append((head, tail))
        owed = np.zeros(len(roots) * n)
        for head, tail in reversed(down):
            np.add.at(owed, head, (1 + owed[tail]) * (paths[head] / paths[tail]))
        owed[start] = 0.0
        owed_by_all += owed.reshape(len(roots), n).sum(axis=0)
    return ids, owed_by_all


def _owed_in_group(rows: pa.Table) -> pa.Table:
    """Rows a, b are links; rows without b are sources."""
    rows = rows.select(["a", "b"])
    is_link = rows["b"].is_valid()
    links = rows.filter(is_link)
    v, part = _dependencies(links["a"].to_numpy(), links["b"].to_numpy(), rows.filter(pc.invert(is_link))["a"].to_numpy())
    return pa.table({"v": v, "part": part})


def _owed_by_joins(near: DataFrame, picked: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """``v, part`` for all sources (column s) at once, as joins, and the tables written.

    A level's nodes and path counts come from the links of the level before; then
    dependencies are summed backward over the stored levels.  Of an undirected graph a
    level's neighbours lie in it, the one before, or the next, so only these are looked at."""
    levels = [cut(picked.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")))]
    while True:
        before = levels[-1].select("s", "v")
        before = before if len(levels) == 1 else before.unionAll(levels[-2].select("s", "v"))
        reached = levels[-1].join(near, F.col("v") == F.col("a")).groupBy("s", "b").agg(F.sum("paths").alias("paths")).withColumnRenamed("b", "v")
        level = cut(reached.join(before, ["s", "v"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
    given, parts, written = None, [], []
    for above, level in reversed([*zip(levels[:-1], levels[1:], strict=True)]):
        owed = level.withColumn("owed", F.lit(0.0)) if given is None else level.join(given, ["s", "v"], "left").withColumn("owed", F.coalesce("owed", F.lit(0.0)))
        owed = cut(owed.select("s", "v", "paths", "owed"))
        written.append(owed)
        parts.append(owed.groupBy("v").agg(F.sum("owed").alias("part")))
        back = owed.join(near, F.col("v") == F.col("a")).select("s", F.col("b").alias("v"), ((1 + F.col("owed")) / F.col("paths")).alias("share"))
        given = back.join(above, ["s", "v"]).groupBy("s", "v").agg((F.sum("share") * F.first("paths")).alias("owed"))
    return reduce(DataFrame.unionAll, parts) if parts else None, [*levels, *written]


def betweenness(nodes: DataFrame, edges: DataFrame, sources: int | None = 400, seed: int = 1) -> DataFrame:
    """Unweighted betweenness from sampled sources (all nodes, if sources is None), and
    bridge score bc / sqrt(docs).  nodes: id, doc_count.

    Brandes' algorithm (2001).  A component's links are sent to groups of its sources,
    each a task's work, so that no source's paths are shuffled.  A component whose links
    are too many for a group goes level by level as joins, in batches of sources."""
    nodes = cut(nodes.select("id", "doc_count"))
    link = edges.select(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b")).filter("a <> b")
    near = cut(link.unionAll(link.select("b", "a")).distinct())
    n = near.select("a").distinct().count()
    if sources is None:
        picked, k = near.select(F.col("a").alias("s")).distinct(), n
    else:
        picked = nodes.select(F.col("id").cast("bigint").alias("s")).orderBy(F.xxhash64("s", F.lit(seed)), "s").limit(sources)
        k = picked.count()
    root = cut(_components(near))
    near = cut(near.join(root, F.col("a") == F.col("node")).select("root", "a", "b"))
    picked = cut(picked.join(root, F.col("s") == F.col("node")).select("root", "s"))
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("links")).join(picked.groupBy("root").agg(F.count(F.lit(1)).alias("picks")), "root")
    sizes = cut(sizes.withColumn("groups", F.ceil(F.col("picks") / GROUP_SOURCES)))
    one, many = sizes.filter(F.col("links") <= GROUP_LINKS), sizes.filter(F.col("links") > GROUP_LINKS)
    found = []
    groups, rows, steps = one.agg(F.sum("groups"), F.sum(F.col("groups") * F.col("links") + F.col("picks")), F.sum(F.col("picks") * F.col("links"))).first()
    if groups:
        sent = near.join(one, "root").select("root", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("part"), "a", "b")
        asked = picked.join(one, "root").select("root", F.pmod(F.xxhash64("s"), "groups").alias("part"), F.col("s").alias("a"), F.lit(None).cast("bigint").alias("b"))
        # by number, lest tasks of few rows but much work be joined
        tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups, -(-steps // TASK_STEPS)), -(-rows // TASK_ROWS))
        found.append(sent.unionAll(asked).repartition(tasks, "root", "part").groupBy("root", "part").applyInArrow(_owed_in_group, "v bigint, part double"))
    steps = many.agg(F.sum(F.col("picks") * F.col("links"))).first()[0] or 0
    wide, asked = near.join(many, "root", "left_semi").select("a", "b"), picked.join(many, "root", "left_semi")
    batches, total = -(-steps // BATCH_STEPS), None
    for batch in range(batches):
        owed, written = _owed_by_joins(wide, asked.filter(F.pmod(F.xxhash64("s"), F.lit(batches)) == batch))
        if owed is not None:
            last, total = total, cut((owed if total is None else owed.unionAll(total)).groupBy("v").agg(F.sum("part").alias("part")))
            drop(*([last] if last is not None else []))
        drop(*written)
    found += [total] if total is not None else []
    scale = n / max(1, k) / ((n - 1) * (n - 2)) if n > 2 else 1.0
    out = nodes.select(F.col("id").cast("bigint").alias("id"), "doc_count")
    if found:
        every = reduce(DataFrame.unionAll, found).groupBy(F.col("v").alias("id")).agg((F.sum("part") * scale).alias("betweenness"))
        out = out.join(every, "id", "left").fillna(0.0, ["betweenness"])
    else:
        out = out.withColumn("betweenness", F.lit(0.0))
    return out.withColumn("bridge", F.col("betweenness") / F.sqrt("doc_count"))


def label_propagation(edges: DataFrame, weight: str = "docs", rounds: int = 10) -> DataFrame:
    """Communities by weighted label propagation: ``node, community``.  Each round
    gives a node the label with the most weight around it (ties: the smallest); a
    node's own label counts with half its strongest link, which ends oscillation."""
    links = cut(both_ways(edges.select("src", "dst", F.col(weight).cast("double").alias("w"))))
    own = links.groupBy("node").agg((F.max("w") / 2).alias("w"))
    labels = links.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label", "w").unionAll(own.join(labels, "node").select("node", "label", "w"))
        score = votes.groupBy("node", "label").agg(F.sum("w").alias("score"))
        labels = score.groupBy("node").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("label"))
        labels = cut(labels)
    return labels.select("node", F.col("label").alias("community"))


#: Weights are whole multiples of this, so that sums do not depend on their order.
UNIT = 1e-6
#: A round of moves is made by one in so many nodes.
PARTS = 4


def _move(links: DataFrame, nodes: DataFrame, m2: int, resolution: float, turn: int) -> DataFrame:
    """One round of local moves: ``node, k, home``.  One in PARTS nodes, in the next turn
    others, may go to the community around them that gains modularity most, ties
    to the smaller one; two neighbours that would swap seldom both may.

    links: node, other, w (both ways, no loops); nodes: node, k (degree), home.  The
    gains of a node are summed before they meet: links by (node, community), degrees by
    community."""
    total = nodes.groupBy("home").agg(F.sum("k").alias("total")).select(F.col("home").alias("to"), "total")
    around = links.join(nodes.select(F.col("node").alias("other"), F.col("home").alias("to")), "other").groupBy("node", "to").agg(F.sum("w").alias("w"))
    here = nodes.select("node", F.col("home").alias("to"), F.lit(0).cast("bigint").alias("w"))
    scored = around.select("node", "to", "w").unionAll(here).join(nodes, "node").join(total, "to")
    stays = F.col("to") == F.col("home")
    others = (F.col("total") - F.when(stays, F.col("k")).otherwise(0)).cast("double")
    gain = F.col("w").cast("double") - F.lit(resolution) * others * F.col("k").cast("double") / F.lit(float(m2))
    scored = scored.withColumn("gain", gain).withColumn("rest", F.when(stays, F.col("gain")))
    # links into the own community came as a row of their own beside ``here``
    best = scored.groupBy("node", "k", "home").agg(F.max_by("to", F.struct("gain", -F.col("to"))).alias("to"), F.max("gain").alias("gain"), F.max("rest").alias("rest"))
    free = F.pmod(F.pmod(F.xxhash64("node", F.lit(turn // PARTS)), F.lit(PARTS)) + turn, F.lit(PARTS)) == 0
    moves = free & (F.col("gain") > F.col("rest") + 1e-9)
    return best.select("node", "k", F.when(moves, F.col("to")).otherwise(F.col("home")).alias("home"))


def _modularity(links: DataFrame, nodes: DataFrame, looped: int, m2: int, resolution: float) -> float:
    """Of the partition ``home``, in one pass; looped: the weight of loops, counted twice."""
    a, b = nodes.select("node", F.col("home").alias("a")), nodes.select(F.col("node").alias("other"), F.col("home").alias("b"))
    inside = links.join(a, "node").join(b, "other").filter("a = b").select(F.col("a").alias("home"), "w", F.lit(0).cast("bigint").alias("k"))
    each = inside.unionAll(nodes.select("home", F.lit(0).cast("bigint"), "k")).groupBy("home").agg(F.sum("w").alias("w"), F.sum("k").cast("double").alias("k"))
    inner, spread = each.agg(F.sum("w"), F.sum(F.pow(F.col("k") / F.lit(float(m2)), F.lit(2.0)))).first()
    return ((inner or 0) + looped) / m2 - resolution * (spread or 0.0)


def _settle(graph: DataFrame, nodes: DataFrame, m2: int, resolution: float, sweeps: int) -> tuple[DataFrame, bool]:
    """Sweeps of local moves, PARTS rounds each, while modularity grows; and whether it
    did.  A sweep that makes it less is not kept."""
    links = graph.filter("node <> other")
    looped = graph.filter("node = other").agg(F.sum("w")).first()[0] or 0
    nodes = cut(nodes)
    best, changed = _modularity(links, nodes, looped, m2, resolution), False
    for sweep in range(sweeps):
        moved, done = nodes, []
        for turn in range(PARTS):
            moved = cut(_move(links, moved, m2, resolution, sweep * PARTS + turn))
            done.append(moved)
        now = _modularity(links, moved, looped, m2, resolution)
        if now <= best + 1e-12:
            drop(*done)
            break
        drop(nodes, *done[:-1])
        best, nodes, changed = now, moved, True
    return nodes, changed


def communities(edges: DataFrame, weight: str = "docs", resolution: float = 1.2, sweeps: int = 10, levels: int = 8) -> DataFrame:
    """``node, community`` by Louvain's method (Blondel et al. 2008), as joins and sums.

    A level is up to ``sweeps`` sweeps of local moves, in rounds of a part of the nodes;
    then every community becomes a node of the next level, whose links are sums of
    links.  At the end single nodes move once more, which mends what was merged too
    early.  The label is the smallest member; results do not depend on how rows are
    dealt.  Repeated and opposite edges add up; weights that are null or not positive
    are left out."""
    kind = edges.schema["src"].dataType.simpleString()
    w = F.round(F.col(weight).cast("double") / UNIT).cast("bigint")
    plain = edges.select(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b"), w.alias("w")).filter("w > 0 and a is not null and b is not null")
    first = cut(plain.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").unionAll(plain.select("b", "a", "w")).groupBy("node", "other").agg(F.sum("w").alias("w")))
    m2 = first.agg(F.sum("w")).first()[0] or 1
    degrees = first.groupBy("node").agg(F.sum("w").alias("k"))
    graph, home = first, None
    for _ in range(levels):
        own = graph.groupBy("node").agg(F.sum("w").alias("k"), F.first("node").alias("home"))
        settled, changed = _settle(graph, own, m2, resolution, sweeps)
        found = settled.select("node", "home")
        home = found if home is None else cut(home.select("node", F.col("home").alias("via")).join(found.select(F.col("node").alias("via"), "home"), "via").select("node", "home"))
        if not changed:
            break
        a, b = found.select("node", F.col("home").alias("a")), found.select(F.col("node").alias("other"), F.col("home").alias("b"))
        graph = cut(graph.join(a, "node").join(b, "other").groupBy("a", "b").agg(F.sum("w").alias("w")).select(F.col("a").alias("node"), F.col("b").alias("other"), "w"))
    home, _ = _settle(first, degrees.join(home, "node"), m2, resolution, sweeps)
    label = home.groupBy("home").agg(F.min("node").alias("community"))
    return home.join(label, "home").select(F.col("node").cast(kind).alias("node"), F.col("community").cast(kind).alias("community"))


def gexf(nodes: DataFrame, edges: DataFrame, limit: int = 50_000) -> str:
    """GEXF document of a bounded graph: nodes (id, name), edges (src, dst, docs); a
    graph of more than ``limit`` nodes or edges is an error."""
    from xml.sax.saxutils import quoteattr

    if max(nodes.limit(limit + 1).count(), edges.limit(limit + 1).count()) > limit:
        raise ValueError(f"more than {limit} nodes or edges")
    rows = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>']
    rows += [f"<node id={quoteattr(str(r['id']))} label={quoteattr(r['name'] or '')}/>" for r in nodes.select("id", "name").orderBy("id").limit(limit).collect()]
    rows.append("</nodes><edges>")
    for k, r in enumerate(edges.select("src", "dst", "docs").orderBy("src", "dst").limit(limit).collect()):
        rows.append(f'<edge id="{k}" source="{r["src"]}" target="{r["dst"]}" weight="{r["docs"]}"/>')
    return "\n".join([*rows, "</edges></graph></gexf>"])


def by_metric(metric: str) -> Column:
    return F.desc("npmi") if metric == "npmi" else F.desc("docs")
