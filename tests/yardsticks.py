"""Plain algorithms that results of the engine are measured by."""

from __future__ import annotations

import random


def louvain(links: list[tuple[int, int, float]], resolution: float = 1.2, seed: int = 7) -> dict[int, int]:
    """Louvain communities (Blondel et al. 2008) of a graph that fits one machine,
    one node after another; the label is the smallest member."""
    graph: dict[int, dict[int, float]] = {}
    for a, b, w in links:
        graph.setdefault(a, {})[b] = graph.setdefault(a, {}).get(b, 0.0) + w
        graph.setdefault(b, {})[a] = graph.setdefault(b, {}).get(a, 0.0) + w
    member = {v: {v} for v in graph}
    rng = random.Random(seed)
    while graph:
        degree = {v: sum(w for u, w in near.items()) + near.get(v, 0.0) for v, near in graph.items()}
        m2 = sum(degree.values())
        if not m2:
            break
        home = {v: v for v in graph}
        total = dict(degree)
        order = sorted(graph)
        rng.shuffle(order)
        moved_ever, moved = False, True
        while moved:
            moved = False
            for v in order:
                links_to: dict[int, float] = {}
                for u, w in graph[v].items():
                    if u != v:
                        links_to[home[u]] = links_to.get(home[u], 0.0) + w
                old = home[v]
                total[old] -= degree[v]
                gain = lambda c: links_to.get(c, 0.0) - resolution * total[c] * degree[v] / m2  # noqa: B023, E731
                best = max(sorted(links_to), key=gain, default=old)
                if gain(best) <= gain(old) + 1e-12:
                    best = old
                home[v] = best
                total[best] += degree[v]
                if best != old:
                    moved = moved_ever = True
        if not moved_ever:
            break
        merged: dict[int, dict[int, float]] = {}
        joined: dict[int, set[int]] = {}
        for v, near in graph.items():
            joined.setdefault(home[v], set()).update(member[v])
            row = merged.setdefault(home[v], {})
            for u, w in near.items():
                row[home[u]] = row.get(home[u], 0.0) + (w if u != v or home[u] != home[v] else w)
        graph, member = merged, joined
    return {x: min(group) for group in member.values() for x in group}


def modularity(links: list[tuple[int, int, float]], home: dict[int, int], resolution: float = 1.2) -> float:
    """Of a partition of an undirected graph; every link is given once."""
    m2 = 2 * sum(w for _, _, w in links)
    degree: dict[int, float] = {}
    inside = 0.0
    for a, b, w in links:
        degree[a] = degree.get(a, 0.0) + w
        degree[b] = degree.get(b, 0.0) + w
        inside += 2 * w * (home[a] == home[b])
    total: dict[int, float] = {}
    for v, k in degree.items():
        total[home[v]] = total.get(home[v], 0.0) + k
    return inside / m2 - resolution * sum((t / m2) ** 2 for t in total.values())
