"""Periodic runs, conversation tries and spot signatures against plain Python."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sextant.llm import chat, periodic, quality, queries, spotsigs, topk, trie


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df):
    return [tuple(r) for r in df.collect()]


# ------------------------------------------------------------------ 4 top-k
def test_cells_are_coarser_than_the_values():
    rnd = topk.np.random.default_rng(4)
    for n, dim in ((1, 3), (50, 5), (3000, 7), (4, 0)):
        exact = topk.np.floor(rnd.normal(0, 5000, (n, dim)))
        a = topk.Approximation.of(topk.np.arange(n), topk.np.arange(n), exact)
        assert (topk.Approximation.unpacked(a.packed(), n, dim) == a.cells).all() and len(a.packed()) <= (n * dim * topk.BITS + 7) // 8
        low, high = (topk.np.take_along_axis(x, a.cells.astype(int), axis=0) for x in (a.low, a.high))
        assert ((low <= exact) & (exact <= high)).all()
        assert n < 3000 or topk.np.bincount(a.cells[:, 0]).max() < 3 * n / topk.CELLS


@pytest.mark.parametrize("width", [0.12, 40.0])
def test_few_exact_vectors_are_read(spark, width):
    rnd = topk.np.random.default_rng(5)
    data = [(k, v.tolist()) for k, v in enumerate(rnd.normal(0, width, (2000, 32)))]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(4)
    report = {}
    got = rows(topk.top_k(df, F.col("vec_id") % 100 == 0, k=5, report=report))
    whole = topk.np.floor(topk.np.array([v for _, v in data]) * 256)
    for q in (0, 700, 1900):
        scores = whole @ whole[q]
        best = [j for j in topk.np.lexsort((topk.np.arange(2000), -scores)).tolist() if j != q][:5]
        assert [(v, s) for a, _, v, s in sorted(got) if a == q] == [(j, int(scores[j])) for j in best]
    assert report["pairs"] == 20 * 2000 and report["read"] < 0.05 * report["pairs"]


# ------------------------------------------------------------------ 2 chat log
def test_a_long_turn_is_logged_in_linear_time(spark):
    text = F.repeat(F.concat(F.lit("é漢 xyz.\n-"), F.col("id").cast("string")), F.lit(500_000))
    df = spark.range(3).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), text.alias("text"))
    began = time.monotonic()
    found = chat.fold(chat.log_of_turns(df, streamed=True)).select("place", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("m"))
    assert sorted(rows(found)) == [(k + 1, 5_000_000, hashlib.md5((f"é漢 xyz.\n-{k}" * 500_000).encode()).hexdigest()) for k in range(3)]
    assert time.monotonic() - began < 120


def test_some_regenerations_discard_later_turns(spark):
    df = spark.range(200).select(F.floor(F.col("id") / 8).alias("conv_id"), (F.col("id") % 8).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    log = chat.log_of_turns(df, streamed=True).cache()
    again = log.filter("kind = 'regenerate'").select("conv_id", F.col("place").alias("r_place"), F.col("seq").alias("r_seq"))
    lost = log.join(again, "conv_id").filter("place > r_place and seq < r_seq and kind = 'message'")
    assert lost.count() > 3
    order = ["conv_id", "place"]
    assert rows(chat.fold(log).orderBy(order)) == rows(chat.fold(chat.log_of_turns(df)).orderBy(order))


# ------------------------------------------------------------------ 11 periodic runs
def runs_by_hand(w):
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > start and i + p - start >= max(6, 4 * p):
                found.setdefault((start, i + p - start), p)  # a smaller period with the same ends came before
            i = max(i, start + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed_by_hand(w, runs):
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def test_runs_of_random_texts():
    rnd = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randrange(1, 9)):
            t = [b"%d" % rnd.randrange(rnd.choice([1, 2, 3, 40])) for _ in range(rnd.choice([0, 1, 5, 6, 7, 25, 90]))]
            if len(t) > 8 and rnd.random() < 0.6:
                start, p = rnd.randrange(len(t) // 2), rnd.randrange(1, 7)
                for i in range(start + p, min(len(t), start + p * rnd.randrange(2, 9))):
                    t[i] = t[i - p]
            texts.append(t)
        runs, kept, at = periodic.runs_of(texts)
        for k, t in enumerate(texts):
            want = runs_by_hand(t)
            assert [tuple(r[1:]) for r in runs.tolist() if r[0] == k] == sorted(want, key=lambda r: (r[0], r[2]))
            assert b" ".join(w for w, stays in zip(t, kept[at[k] : at[k + 1]], strict=True) if stays).decode() == collapsed_by_hand([x.decode() for x in t], want)


def test_runs_ask_in_parts(monkeypatch):
    monkeypatch.setattr(periodic, "QUESTIONS", 7)
    texts = [[b"a", b"b"] * 30, [b"x"] * 50, [b"%d" % k for k in range(80)], []]
    runs, _, _ = periodic.runs_of(texts)
    assert runs.tolist() == [[0, 0, 60, 2], [1, 0, 50, 1]]


def test_long_runs_are_fast():
    runs, _, _ = periodic.runs_of([[b"x"] * 100_000, [b"%d" % (k % 30_000) for k in range(150_000)]])
    assert runs.tolist() == [[0, 0, 100_000, 1], [1, 0, 150_000, 30_000]]


def test_find_runs(awkward, nothing):
    got = rows(periodic.find_runs(awkward))
    want = []
    for d, text in awkward.select("doc_id", "text").collect():
        w = words(text)
        runs = runs_by_hand(w) if len(w) < 1000 else []
        want.append((d, len(w), [tuple(r) for r in runs], collapsed_by_hand(w, runs)))
    got = [(d, n, [tuple(r) for r in runs], c) for d, n, runs, c in got]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert periodic.find_runs(nothing).count() == 0


def test_op11_query(spark, tmp_path):
    rnd = random.Random(8)
    data = [(k, " \n".join(rnd.choice("ab cd ef gh ij kl".split()) for _ in range(rnd.choice([0, 1, 4, 30, 120])))) for k in range(120)] + [(500, None), (None, "a a a a a a a"), (501, "")]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    want = []
    for d, text in data:
        w, h = words(text), zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            planted += 1
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = sorted(runs_by_hand(w), key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in runs), collapsed_by_hand(w, runs))]
        want.append((d, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests))
    assert planted > 3
    got = queries.op11_periodic_runs(spark, str(tmp_path)).drop("n_words")
    assert sorted(map(str, rows(got))) == sorted(map(str, want))


# ------------------------------------------------------------------ 12 prefix trie
def trie_by_hand(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    least = lambda cs: min((c for c in cs if c is not None), default=None)
    out = []
    for node in members:
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(y[:-1] == x for y in members if y)]
        saved = sum((len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0) for x in below)
        children = sum(1 for x in members if x and x[:-1] == node)
        said = ",".join(str(c) for c in sorted(c for c in ends[node] if c is not None))
        out.append((least(members[node]), len(node), least(members[node[:-1]]) if node else None, len(members[node]), children, len(leaves), saved, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(map(str, out))


def random_turns(seed, n):
    rnd = random.Random(seed)
    out = []
    for c in [*range(n), None]:
        out += [(c, t, rnd.choice(["user", None]), rnd.choice(["a", "bé", None, ""]), "extra", 1) for t in range(rnd.choice([1, 2, 3, 6]))]
    for c in range(n, n + n // 2):  # copies, and one that goes on
        out += [(c, t, "user", "same", "extra", 1) for t in range(4 + (c == n))]
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string, key string, place int"


def folded(turns):
    found = defaultdict(list)
    for c, t, role, text, *_ in turns:
        label = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
        found[c].append((t is not None, t or 0, label, (role or "", text or "")))
    return {c: [x[3] for x in sorted(v)] for c, v in found.items()}


@pytest.mark.parametrize("heavy", [1, 2, 1000])
def test_trie(spark, heavy, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_NODES", 5)
    turns = random_turns(4, 30) + [(7, None, "user", "first", "x", 0), (8, 1, "user", "a", "x", 0), (8, 1, "user", "a", "x", 0)]
    df = spark.createDataFrame(turns, TURNS).repartition(3)
    more = spark.createDataFrame([(3,), (900,), (901,)], "conv_id bigint")
    got = rows(trie.prefix_trie(trie.numbered(df), more, heavy=heavy))
    assert sorted(map(str, got)) == trie_by_hand(folded(turns) | {900: [], 901: []})


def test_trie_of_nothing_and_of_one_long_path(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(trie.numbered(empty)).count() == 0
    only = spark.createDataFrame([(4,), (2,)], "conv_id bigint")
    assert rows(trie.prefix_trie(trie.numbered(empty), only)) == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]
    long = spark.range(20_000).select((F.col("id") % 2).alias("conv_id"), F.floor(F.col("id") / 2).alias("turn"), F.lit("user").alias("role"), F.lit("x" * 10).alias("text"))
    got = trie.prefix_trie(trie.numbered(long)).filter("depth in (0, 1, 10000)").orderBy("depth")
    assert [(r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in got.collect()] == [(2, 1, 1, 100_000), (2, 1, 1, 100_000), (2, 0, 1, 10)]


def test_op12_query(spark, tmp_path):
    turns = [r for r in random_turns(9, 40) if r[0] is None or r[0] % 10 != 5]  # conversations 5, 15, ... are absent
    spark.createDataFrame(turns, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    own = folded(turns)
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if c is not None else 0
        built[c] = (own.get(c - c % 5, [])[:h] if c is not None else []) + said[h:]
    assert sorted(map(str, rows(queries.op12_prefix_trie(spark, str(tmp_path))))) == trie_by_hand(built)


def test_louds():
    parents = [0, 0, 1, 1, 2, 4, 4]
    made = trie.Louds(trie.np.array(parents), trie.np.array([0, 1, 3, 6, 8]))
    assert made.parents().tolist() == parents and made.degrees().tolist() == [2, 2, 1, 0, 2, 0, 0, 0]
    leaves = (made.degrees() == 0).astype("int64")
    made.rolled_up(leaves)
    assert leaves.tolist() == [4, 3, 1, 1, 2, 1, 1, 1]


# ------------------------------------------------------------------ 13 spot signatures
def spots_by_hand(text):
    w = words((text or "").lower())
    content = [None if x in quality.STOP_WORDS else x for x in w]
    chains = []
    for i in range(len(w) - 1):
        if content[i] is None and content[i + 1] is not None:
            after = [x for x in content[i + 2 : i + 1 + spotsigs.REACH] if x is not None][:1]
            chains.append([w[i], content[i + 1], *after])
    chains = chains or [w[i : i + 3] for i in range(len(w))]
    return {hashlib.md5(" ".join(c).encode()).hexdigest()[: spotsigs.DIGITS] for c in chains}


def near_by_hand(a, b):
    x = len(a & b) / len(a | b) if a | b else 1.0
    return x if x >= spotsigs.LEAST else 0.0


def in_order(data):
    """Rows by id, null first."""
    return sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))


def check_fingerprints(found, data):
    texts = [t or "" for _, t in in_order(data)]
    want = []
    for k, text in enumerate(texts):
        after, q = texts[(k + 1) % len(texts)], len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = map(spots_by_hand, (text, edited, after))
        want.append((in_order(data)[k][0], len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(a)), "".join(sorted(b)), near_by_hand(a, b), near_by_hand(a, c)))
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_op13_query(spark, tmp_path, awkward, nothing, monkeypatch):
    data = rows(awkward.select("doc_id", "text").distinct())
    awkward.dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/a/documents.parquet")
    check_fingerprints(rows(queries.op13_spot_signatures(spark, f"{tmp_path}/a")), data)
    nothing.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.op13_spot_signatures(spark, f"{tmp_path}/b").count() == 0
    rnd = random.Random(6)
    many = [(k * 7, " ".join(rnd.choice("the a of house river runs old cat der Hund und".split()) for _ in range(rnd.randrange(40)))) for k in range(300)]
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 9)
    spark.createDataFrame(many, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/c/documents.parquet")
    check_fingerprints(rows(queries.op13_spot_signatures(spark, f"{tmp_path}/c")), many)


def test_next_of_repeated_ids(spark, monkeypatch):
    """An id of many rows fills several buckets; every row is followed by the next by a hash of the text."""
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 10)
    data = [(5, f"t{k}") for k in range(200)] + [(None, f"n{k}") for k in range(60)] + [(k, "x") for k in (1, 2, 9)] + [(5, "t7")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("mark", F.xxhash64(F.col("text").cast("binary")))
    ordered = [r["text"] for r in df.orderBy(F.asc_nulls_first("doc_id"), "mark").collect()]
    got = rows(spotsigs.with_next(df, {"up": F.upper("text")}, ["text", "up"]).select("text", "next_text", "next_up"))
    assert sorted(got) == sorted((t, n, n.upper()) for t, n in zip(ordered, ordered[1:] + ordered[:1], strict=True))


def test_likeness_of_partitions(spark):
    assert [spark.range(1).select(spotsigs.partition(F.array(*[F.lit(str(k)) for k in range(n)]).cast("array<string>"))).first()[0] for n in (0, 1, 9, 10, 99, 100)] == [-1, 0, 0, 1, 1, 2]
