"""Operators that no SQL covers, on small cases."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant import scratch
from sextant.functions import dates as DT
from sextant.functions import fold as FO
from sextant.functions import names as N
from sextant.functions import text as TX
from sextant.functions.porter import stem
from sextant.operators import codenames as CN
from sextant.operators import documents as D
from sextant.operators import edges as E
from sextant.operators import graph as GR
from sextant.operators import matcher as MA
from sextant.operators import mentions as M
from sextant.operators import metadata as MD
from sextant.operators import timeline as T
from sextant.sources import discover, formats, links
from tests import yardsticks


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r["y"] for r in df.select("k", expr(F.col("x")).alias("y")).orderBy("k").collect()]


def test_tokens(spark):
    got = column(spark, ["The U.S. navy's Yahoo! O’Neill co-op. x's AT&T", "Привет мир", None, "a.b. rock'"], TX.tokens)
    assert got == [["The", "U.S.", "navy", "Yahoo!", "O'Neill", "co-op", "x's", "AT&T"], ["Привет", "мир"], [], ["a.b.", "rock"]]


def test_all_caps(spark):
    assert column(spark, ["A" * 39, "A" * 40, "A" * 34 + "b" * 6, "A" * 33 + "b" * 7, None, "Я" * 40], TX.is_all_caps) == [False, True, True, False, False, True]


def test_identifiers(spark):
    assert column(spark, ["Call +49 (30) 123-4567, +1 2, or +123456789012345678."], TX.phones) == [["+49301234567"]]
    assert column(spark, ["A.B@X.org. a.b@x.org c@d"], TX.emails) == [["a.b@x.org"]]
    assert column(spark, ["DE89 3704 0044 0532 0130 00, GB29NWBK60161331926818"], TX.ibans) == [["DE89370400440532013000"]]


def test_dates(spark):
    values = ["1966-12-28", "12/28/1966 18:48", "28 Dec 1966", "December 8, 1966", "8.12.1966", "19661208", "12/8/66", "8-Dec-66", "in 1966", "1966-13-01", "", None, "1962-02-31", "around the year 1966 or so"]
    assert column(spark, values, DT.parse) == ["1966-12-28", "1966-12-28", "1966-12-28", "1966-12-08", "1966-12-08", "1966-12-08", "1966-12-08", "1966-12-08", "1966", "1966", "", "", "1962-02-31", ""]
    assert column(spark, ["x/1999-01-02 a.txt", "a 3 feb 62.txt", "a20010203b.txt", "a99991399.txt"], lambda c: DT.from_filename(c, 1900, 2100)) == ["1999-01-02", "2062-02-03", "2001-02-03", ""]
    assert column(spark, ["Seen March 4, 1999 and 5 May 2001", "Seen March 4, 1999", "99 May 2001 and March 4, 1999"], lambda c: DT.from_text(c, 1900, 2100)) == ["2001-05-05", "1999-03-04", "1999-03-04"]
    assert column(spark, ["1962", "1962-02-31", "", "x"], DT.year_of) == [1962, 1962, None, None]
    assert [str(x) for x in column(spark, ["1577836800", "1577836800000", "2020-01-01T23:30:00-05:00", "2020-01-01 08:00", "soon"], DT.wall_clock)] == ["2020-01-01 00:00:00", "2020-01-01 00:00:00", "2020-01-01 23:30:00", "2020-01-01 08:00:00", "None"]
    assert column(spark, ["Fri, 02 Jan 2004 23:30:00 -0500"], DT.rfc822) == ["2004-01-02"]


@pytest.mark.parametrize(
    ("raw", "name"),
    [("Dr. John Q. Smith's", "John Smith"), ("Walter E. FAUNTROY", "Walter Fauntroy"), ("Mary O'Neill", "Mary O'Neill"), ("José Müller", "José Müller"), ("Smith", None), ("The Report", None), ("Ana de la Cruz", "Ana de la Cruz"), ("John Smith Ann Brown", None), ("A B", None), ("Bob Bob", None), ("JOHN SMITH", None)],
)
def test_persons(raw, name):
    assert N.normalize_person(raw) == name


def test_other_names(spark):
    assert N.normalize_person("JOHN SMITH", allcaps=True) == "John Smith"
    given = ["Al Gore", "Van Morrison", "Bin Laden", "Dr. Abu Zubaydah Hassan Omar", "Maria de la Cruz", "Maria De La Cruz", "van der Berg", "John van", "Ann Van Buren NASSER"]
    assert [N.normalize_person(x) for x in given] == ["Al Gore", "Van Morrison", "Bin Laden", "Abu Zubaydah Hassan Omar", "Maria de la Cruz", None, None, None, None]
    assert N.display_name("Gore, Al") == "Al Gore"
    assert [N.normalize_org(x) for x in ("Attn", "FYI", "PAC", "the Board", "Board of Trade")] == [None, None, None, None, "Board of Trade"]
    assert [N.display_name(x) for x in ("Smith, John", '"JOHN SMITH" ', "John Smith (Legal)", "a@b.c", "")] == ["John Smith", "John Smith", "John Smith", None, None]
    assert [N.normalize_org(x) for x in ("the Harbour Board's", "committee", "ab", "UN", "lower case")] == ["Harbour Board", None, None, "UN", None]
    assert column(spark, ["Gull Shipping Ltd.", "Ltd", "Ada Brook"], N.looks_like_company) == [True, False, False]
    assert FO.plain_text("Peña Nieto") == "pena nieto" and FO.plain_text("Йод") == "иод" and FO.title_words("O'NEILL-brown") == "O'Neill-Brown"
    assert FO.fold_key("person", "JOSÉ  Ruiz") == "person:jose ruiz" and FO.fold_key("x", "Йод") == "x:йод"
    assert [stem(w) for w in "running nationalization hopping skies agreed happy relational".split()] == ["run", "nation", "hop", "ski", "agre", "happi", "relat"]


def test_matcher(spark):
    t = MA.Trie(frozenset({"orange"}))
    for alias, key, kind in (("Tarn Mills", "a", "company"), ("Tarn Mills Ltd", "b", "company"), ("Turkey", "c", "place"), ("wire", "d", "technology"), ("Orange", "e", "company"), ("TM2", "f", "company"), ("Turkey", "z", "place")):
        t.add(alias, alias.split(), key, kind)
    find = lambda s, caps=False: list(t.find(s.split(), caps))
    assert find("at tarn mills ltd and Tarn mills") == ["b", "a"] and find("Turkey turkey Wire wire TM2 tm2") == ["c", "d", "d", "f"]
    assert find("TARN MILLS ORANGE TURKEY", True) == ["a", "c"] and find("TARN MILLS TURKEY") == ["a"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=3), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), max_size=14))
def test_matcher_is_leftmost_longest(aliases, text):
    t = MA.Trie()
    owner = {}
    for k, path in enumerate(aliases):
        if len(path) > 1:
            t.add(" ".join(path), path, str(k))
            owner.setdefault(tuple(path), str(k))
    want, at = [], 0
    while at < len(text):
        hit = next((tuple(text[at : at + n]) for n in (3, 2) if tuple(text[at : at + n]) in owner and at + n <= len(text)), None)
        if hit:
            want.append(owner[hit])
        at += len(hit) if hit else 1
    assert list(t.find(text)) == want


def test_mention_rules(spark):
    raw = spark.createDataFrame([("k", "d", 1, 3, 0), ("k", "d", 1, 9, 3), ("k", "d", 2, 2, 3), ("s", "d", 1, 0, 4), ("s", "e", 1, 5, 4), ("n", "d", 1, 4, 2)], "key string, doc_id string, page_no int, count int, src int")
    got = {(r["key"], r["doc_id"], r["page_no"]): r["count"] for r in M.mention_facts(M.drop_covered(raw)).collect()}
    assert got == {("k", "d", 1): 3, ("k", "d", 2): 2, ("s", "d", 1): 1, ("s", "e", 1): 1, ("n", "d", 1): 4}


def test_windows_and_hubs(spark):
    rows = [("d", p, e) for p, e in ((1, 1), (5, 2), (6, 3), (6, 2))] + [("hub", 1, e) for e in range(10)]
    m = spark.createDataFrame(rows, "doc_id string, page_no int, entity_id int")
    got = {tuple(r) for r in E.pairs(E.window_entities(m, 5, 9)).collect()}
    assert got == {("d", 1, 2), ("d", 2, 3)}


def test_tasks_of_pairs_follow_their_number(spark, monkeypatch):
    """No task's share of mentions or pairs grows with the table, whatever the session
    shuffles to; without page windows nothing is dealt a second time."""
    monkeypatch.setattr(scratch, "TASK_ROWS", 10)
    m = spark.createDataFrame([(f"d{k}", 1, e) for k in range(20) for e in range(4)], "doc_id string, page_no int, entity_id int")
    windows = E.window_entities(m, None, rows=80)
    assert windows.rdd.getNumPartitions() == 8
    found = E.pairs(windows)
    assert found.rdd.getNumPartitions() == 12 and found.count() == 120
    counted = E.support(found)
    assert counted.rdd.getNumPartitions() == 12 and {tuple(r) for r in counted.collect()} == {(a, b, 20) for a, b in itertools.combinations(range(4), 2)}


def test_npmi(spark):
    one = spark.range(1).select(*[E.npmi(F.lit(a), F.lit(b), F.lit(c), F.lit(10)).alias(f"v{k}") for k, (a, b, c) in enumerate([(10, 10, 10), (2, 2, 2), (1, 5, 5)])]).first()
    assert list(one) == [1.0, 1.0, round(math.log(0.1 / 0.25) / -math.log(0.1), 4)]


def test_codenames(spark):
    page = lambda d, t, ocr=0: (d, 1, t, ocr)
    rows = [page(f"d{k}", "The word REPORT is common REPORT and the MOONRAKER plan met QUIETBELL, see Banner") for k in range(12)]
    rows += [page("o1", "a REPORF here", 1), page("o2", "a REPORF here", 1), page("x1", "use SECRETLY now"), page("x2", "use SECRETLY now")]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string, ocr int")
    known = spark.createDataFrame([("QUIETBELL",)], "token string")
    markings = spark.createDataFrame([("MOONRAKES",)], "m string")
    assert {r["token"] for r in CN.detect(pages, known, spark.createDataFrame([("PRIVATE",)], "m string")).collect()} == {"REPORT", "MOONRAKER"}
    assert "MOONRAKER" not in {r["token"] for r in CN.detect(pages, known, markings).collect()}
    assert CN.segments("QUIETBELL", frozenset({"QUIET", "BELL"})) and not CN.segments("QUIET", frozenset({"QUIET"}))


def test_misreadings(spark):
    vocabulary = spark.createDataFrame([("REPORT", 60, False), ("FIREWALL", 70, False), ("SPECIAL", 800, False), ("JMWAVE", 3, True)], "token string, freq int, known boolean")
    candidates = spark.createDataFrame([("REFORT", 20), ("FIREWALK", 10), ("SPECHAL", 1), ("JEWAVE", 1), ("REPORTS", 30)], "token string, freq int")
    assert {r["token"] for r in CN.misreadings(candidates, vocabulary).collect()} == {"REFORT", "SPECHAL"}


def graph_of(spark, links):
    return spark.createDataFrame([(a, b, w, 0.5) for a, b, w in links], "src int, dst int, docs bigint, npmi double")


def test_strongest_links(spark):
    edges = graph_of(spark, [(1, 2, 5), (1, 3, 5), (1, 4, 1), (3, 4, 9)])
    assert {(r["src"], r["dst"]) for r in GR.strongest_links(edges, 1).collect()} == {(1, 2), (3, 4)}


def test_measures(spark):
    links = [(a, b, 3) for a, b in itertools.combinations(range(1, 6), 2)] + [(a, b, 3) for a, b in itertools.combinations(range(6, 11), 2)] + [(5, 6, 1)]
    edges = graph_of(spark, links)
    nodes = spark.createDataFrame([(k, 4) for k in range(1, 11)], "id int, doc_count bigint")
    between = {r["id"]: r["betweenness"] for r in GR.betweenness(nodes, edges, 100).collect()}
    assert between[5] == between[6] == max(between.values()) and abs(between[5] - 20 * 2 / (9 * 8)) < 1e-9 and between[1] == 0
    spread = {r["node"]: r["community"] for r in GR.label_propagation(edges).collect()}
    assert len({spread[k] for k in range(1, 6)}) == 1 and len({spread[k] for k in range(6, 11)}) == 1
    ranks = {r["node"]: r["rank"] for r in GR.pagerank(graph_of(spark, [(1, 2, 1), (2, 3, 1), (3, 2, 1)]), rounds=40).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[2] > ranks[3] > ranks[1]
    assert '<node id="1"' in GR.gexf(nodes.withColumn("name", F.lit('a"b')), edges)


def test_tasks_of_strongest_links_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 10)
    links = [(a, b, 1 + a) for a, b in itertools.combinations(range(12), 2)]
    dealt, real = [], GR.spread
    monkeypatch.setattr(GR, "spread", lambda df, rows, *c: dealt.append((rows, c)) or real(df, rows, *c))
    kept = GR.strongest_links(graph_of(spark, links), 1)
    assert {(r["src"], r["dst"]) for r in kept.collect()} == {(a, a + 1) for a in range(11)}
    assert dealt == [(132, ("node",)), (66, ("src", "dst"))]


def test_pagerank_rounds_leave_out_what_does_not_change(spark, monkeypatch):
    """Links of nodes that nothing links to are summed once, not joined every round."""
    links = [(a, 100 + a % 7, 1 + a % 3) for a in range(50)] + [(100, 101, 2), (101, 100, 1), (101, 105, 4), (102, 102, 1)]
    total, nodes = {}, {x for a, b, _ in links for x in (a, b)}
    for a, _, w in links:
        total[a] = total.get(a, 0) + w
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        given = dict.fromkeys(nodes, 0.0)
        for a, b, w in links:
            given[b] += want[a] * w / total[a]
        want = {v: (0.15 + 0.85 * (1 - sum(given.values()))) / len(nodes) + 0.85 * given[v] for v in nodes}
    written, real = [], GR.cut
    monkeypatch.setattr(GR, "cut", lambda df: written.append(real(df)) or written[-1])
    got = {r["node"]: r["rank"] for r in GR.pagerank(graph_of(spark, links)).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)
    assert sorted(r["src"] for t in written if t.columns == ["src", "dst", "p"] for r in t.collect()) == [100, 101, 101, 102]


def random_graph(seed, n, m):
    rnd = random.Random(seed)
    made = {}
    for _ in range(m):
        a, b = rnd.randrange(n), rnd.randrange(n)
        if rnd.random() < 0.8:  # mostly within groups of ten
            b = a - a % 10 + rnd.randrange(10)
        if a != b:
            made[min(a, b), max(a, b)] = made.get((min(a, b), max(a, b)), 0) + rnd.randrange(1, 4)
    return [(a, b, w) for (a, b), w in made.items()]


def test_communities_are_as_good_as_louvain_on_one_machine(spark):
    links = random_graph(3, 40, 110)
    found = {r["node"]: r["community"] for r in GR.communities(graph_of(spark, links).repartition(3)).collect()}
    assert all(found[c] == c for c in found.values())
    assert yardsticks.modularity(links, found) >= yardsticks.modularity(links, yardsticks.louvain(links)) - 0.002


def test_communities_of_awkward_graphs(spark):
    assert GR.communities(graph_of(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, 1, 5.0), (2, 3, 0.5), (3, 2, 0.5), (3, 4, None), (None, 4, 1.0), (5, 6, -1.0)], "src int, dst int, docs double")
    assert {tuple(r) for r in GR.communities(odd).collect()} == {(1, 1), (2, 2), (3, 2)}


def test_betweenness_equals_brandes_by_hand(spark):
    links = random_graph(5, 40, 70)
    near = {}
    for a, b, _ in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        depth, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0.0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        owed = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    owed[v] += paths[v] / paths[w] * (1 + owed[w])
            want[w] += owed[w] if w != s else 0
    n = len(near)
    nodes = spark.createDataFrame([(k, 4) for k in near], "id int, doc_count bigint")
    got = {r["id"]: r["betweenness"] for r in GR.betweenness(nodes, graph_of(spark, links)).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v] / ((n - 1) * (n - 2))) < 1e-9 for v in want)
    none = GR.betweenness(nodes, graph_of(spark, [])).collect()
    assert all(r["betweenness"] == 0 for r in none) and len(none) == n


def brandes(links):
    near = {}
    for a, b, _ in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        depth, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0.0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        owed = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    owed[v] += paths[v] / paths[w] * (1 + owed[w])
            total[w] += owed[w] if w != s else 0
    n = len(near)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_betweenness_of_over_400_sources(spark):
    links = [(k, k + 1, 1) for k in range(450)] + [(0, 20, 1), (3, 17, 1), (1000, 1001, 1), (1001, 1002, 1), (5, 5, 1), (20, 0, 2)]
    want = brandes([x for x in links if x[0] != x[1]])
    nodes = spark.createDataFrame([(k, 4) for k in [*want, 9999]], "id int, doc_count bigint")
    got = {r["id"]: r["betweenness"] for r in GR.betweenness(nodes, graph_of(spark, links), None).collect()}
    assert got.keys() == {*want, 9999} and got[9999] == 0 and all(abs(got[v] - want[v]) < 1e-12 for v in want)


@pytest.mark.parametrize("limits", [{"GROUP_SOURCES": 7}, {"GROUP_LINKS": 0, "BATCH_STEPS": 3000}, {"GROUP_LINKS": 10, "TASK_STEPS": 10}])
def test_betweenness_in_groups_and_by_joins(spark, monkeypatch, limits):
    """Groups of a few sources, batches of joins, and both beside each other give the same."""
    links = random_graph(5, 40, 70) + [(k + 100, k + 101, 1) for k in range(5)] + [(200, 201, 1)]
    for name, value in limits.items():
        monkeypatch.setattr(GR, name, value)
    by_joins, real = [], GR._owed_by_joins
    monkeypatch.setattr(GR, "_owed_by_joins", lambda near, picked: by_joins.append(picked.count()) or real(near, picked))
    want = brandes(links)
    nodes = spark.createDataFrame([(k, 4) for k in want], "id int, doc_count bigint")
    got = {r["id"]: r["betweenness"] for r in GR.betweenness(nodes, graph_of(spark, links), None).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)
    assert (sum(by_joins) > 0) == ("GROUP_LINKS" in limits) and (len(by_joins) > 1) == ("BATCH_STEPS" in limits)


def test_exports_refuse_larger_graphs(spark):
    edges = graph_of(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1)])
    nodes = spark.createDataFrame([(k, 1, "n") for k in range(1, 5)], "id int, doc_count bigint, name string")
    with pytest.raises(ValueError, match="more than 3"):
        GR.gexf(nodes, edges, 3)


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7).alias("doc_count")).repartition(9)
    got = [(r["key"], r["id"]) for r in M.entity_ids(rows).orderBy("id").collect()]
    want = sorted(((str(k), k % 7) for k in range(5000)), key=lambda x: (-x[1], x[0]))
    assert got == [(k, n + 1) for n, (k, _) in enumerate(want)] and M.entity_ids(rows.limit(0)).count() == 0


def test_dedupe_choice(spark):
    rows = [("z.zip!/a.txt", "h"), ("long/path/a.txt", "h"), ("keep/deep/down/a.txt", "h"), ("b.txt", "g")]
    got = {r["sha1"]: (r["relpath"], r["duplicates"]) for r in D.dedupe(spark.createDataFrame(rows, "relpath string, sha1 string"), ("keep/",)).collect()}
    assert got == {"h": ("keep/deep/down/a.txt", ["long/path/a.txt", "z.zip!/a.txt"]), "g": ("b.txt", [])}


def test_timeline_limits(spark):
    docs = spark.createDataFrame([(str(k), 2000 + k % 3 if k else None) for k in range(10)], "id string, year int")
    mentions = spark.createDataFrame([(1, str(k)) for k in range(5)], "entity_id int, doc_id string")
    share = T.series(mentions, docs, [1, 2], 1900, 2100, share=True).collect()
    assert len(share) == 6 and all(0 <= r["value"] <= 100 for r in share)
    assert T.series(mentions, docs, [1], 1900, 2100, min_year_docs=4).count() == 0


def test_globs(spark):
    paths = ["a/b/c.txt", "a/c.pdf", "ab/c.txt", "x.txt"]
    keep = lambda i, e: [p for p, k in zip(paths, column(spark, paths, lambda c: discover.wanted(c, i, e)), strict=True) if k]
    assert keep(["a"], []) == keep(["a/"], []) == keep(["a/**"], []) == paths[:2]
    assert keep([], ["*.txt"]) == ["a/c.pdf"] and keep(["a*"], ["a/b"]) == ["a/c.pdf", "ab/c.txt"] and keep([], []) == paths
    assert discover.could_contain("a", ["a/b/*.txt"]) and discover.could_contain("a/b/c", ["a/b"]) and not discover.could_contain("z", ["a/b"])
    assert column(spark, ["x.tar.gz", "x.ZIP", "x.7z", "x.txt"], discover.archive_type) == ["tar", "zip", "7z", None]


def test_page_scans(spark):
    files = spark.createDataFrame([("s/book_2.png", 5, 1), ("s/book_10.png", 7, 9), ("s/book_1.png", 1, 3), ("s/x.txt", 1, 1)], "relpath string, size bigint, mtime int")
    assert [tuple(r) for r in discover.page_scans(files).collect()] == [("s/book", ["s/book_1.png", "s/book_2.png", "s/book_10.png"], 13, 9)]


@pytest.mark.parametrize(
    ("text", "size", "pages"),
    [
        ("short\n\n" + "a" * 60 + " " + "b" * 98, 100, ["short", "a" * 60, "b" * 98]),
        ("one\n\ntwo\n \nthree", 9, ["one\n\ntwo", "three"]),
        ("x" * 8 + "\n\n\n\nyy zz", 10, ["x" * 8, "yy zz"]),
        ("a\fb\n\n" + "c" * 9, 6, ["a", "b", "c" * 6, "c" * 3]),
        (" \f\n\n ", 3, [""]),
    ],
)
def test_paginate(text, size, pages):
    assert formats.paginate(text, size) == pages


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\f", max_size=200), st.integers(3, 40))
def test_paginate_loses_nothing(text, size):
    pages = formats.paginate(text, size)
    assert pages and "".join("".join(pages).split()) == "".join(text.split())
    assert len(text) <= size or all(len(p) <= 2 * size for p in pages)


def test_ocr_merge(spark):
    rows = [("", "scan"), ("x" * 60, "y" * 100), ("x" * 60, "y" * 70), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select(formats.merge_ocr(F.col("a"), F.col("b")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in df] == [("scan", 1), ("x" * 60 + "\n" + "y" * 100, 0), ("x" * 60, 0), ("", 0)]
    pages = spark.createDataFrame([("d", 1, "short"), ("d", 2, "z" * 300)], "doc_id string, page_no int, text string")
    blobs = spark.createDataFrame([("d", "one|two", [0, 4])], "doc_id string, blob string, offsets array<int>")
    assert sorted(r["text"] for r in formats.sidecar_pages(pages, blobs).collect()) == ["one|", "z" * 300]


def test_links(spark):
    pages = spark.createDataFrame([(1, "http://h/a/b.html", '<a href="c.pdf"><a href="/d.PDF?x=1"><a href="http://o/e.doc">'), (2, "http://h/", '<a href="a/c.pdf">')], "page_id int, url string, html string")
    assert {tuple(r) for r in links.page_links(pages, ("pdf",)).collect()} == {("http://h/a/c.pdf", "http://h/a/b.html"), ("http://h/d.PDF?x=1", "http://h/a/b.html")}
    assert column(spark, ["http://h/x/../a b/%41.txt?q#f", "https://h"], TX.dest_path) == ["x/a b/A.txt", ""]


def test_header_forms(spark):
    text = "AGENCY : FBI\nRECORD NUMBER : 12\nAGENCY : again\nTO :\n"
    assert column(spark, [text], lambda c: MD.header_fields(c, ("AGENCY", "RECORD NUMBER", "TO"))) == [{"AGENCY": "FBI", "RECORD NUMBER": "12"}]
    cable = "FM AMEMBASSY NORVALE\nTAGS: PREL, NV\nSUBJECT: HARBOUR TALKS\n\nBody"
    got = column(spark, [cable], lambda c: MD.cable_header(c, {"PREL": "Relations"}, {"NV": "Norvale"}, {}))[0]
    assert got["subject"] == "HARBOUR TALKS" and got["origin"] == "Embassy Norvale" and [e["name"] for e in got["entities"]] == ["PREL — Relations", "Norvale"]


def test_java_patterns(spark):
    assert TX.java_regex(r"(?P<a>\w+)\s[\w-]\Z") == r"(?<a>[\p{L}\p{N}_]+)\p{IsWhite_Space}[\p{L}\p{N}_-]\z"
    rnd = random.Random(1)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 5))) for _ in range(30)]
    got = column(spark, words, CN.deletions)
    assert all(set(g) == {w} | {w[:k] + w[k + 1 :] for k in range(len(w))} for w, g in zip(words, got, strict=True))
