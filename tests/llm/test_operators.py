"""Each operator against plain Python, on awkward rows and on an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sextant.llm import chat, encoding, langid, mixing, packing, quality, similar, simhash, sstable, substring, token_count, topk
from sextant.llm.components import components
from sextant.llm.fmindex import FMIndex, WaveletMatrix, suffix_order

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ------------------------------------------------------------------ 9 quality rules
def test_quality_measures(awkward, nothing):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.quality(awkward).collect()}
    for d, text, *_ in awkward.select("doc_id", "text").collect():
        w = words(text)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[(d, len(w))]
        assert (r["word_chars"], r["n_symbols"], r["n_repeat_words"]) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(covered))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.quality(awkward).count() == awkward.count() and quality.quality(nothing).count() == 0


# ------------------------------------------------------------------ 6 token counts
def test_counts_equal_the_library(awkward, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = rows(token_count.token_counts(awkward, PIECE, limit=100))
    want = [(d, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for d, t in awkward.select("doc_id", "text").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert token_count.token_counts(nothing, PIECE).count() == 0


def test_counts_of_random_texts():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rnd = random.Random(5)
    letters = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", token_count.MARK, "é", "漢", "<s>", "\0", "\U0001f600", "é"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(1500)] + ["ab" * 3000, "the" * 1500, " " * 4000, "漢" * 3000]
    assert token_count.counter(PIECE).count(texts) == [len(x) for x in sp.encode(texts)]


# ------------------------------------------------------------------ encoders, 3 packing, 5 shards
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    rnd = random.Random(7)
    parts = ["a", "The", "foo.", "b,", " ", " ", "  ", "\n", "\t", "É", "é", "漢", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "'s", "1", "!", "\x01", "\x1c", "\x85", "\xa0", " ", "\U0001f600"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(4000)] + [None, ""]
    ids, bounds = encoding.TextEncoder(path, cached=500).encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_long_batches_are_sliced(monkeypatch):
    monkeypatch.setattr(encoding, "SLICE_BYTES", 64)
    texts = [f"some words number {k}" for k in range(40)] + [None, "x" * 300]
    ids, bounds = encoding.encoder(BYTE).encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(BYTE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


@pytest.mark.parametrize("ranked", [2_000, 2])
def test_packing(awkward, nothing, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANK_ROWS", ranked)  # 2: lengths are ranked in several groups
    pieces = packing.pieces(awkward, BYTE, 0)
    got = packing.assign(pieces.select("doc_id", "piece", "start", "length", "ids", F.lit("z").alias("s_rank"), F.lit(1).alias("s_salt"))).collect()
    library = Tokenizer.from_file(BYTE)
    want = Counter()
    for d, text in awkward.select("doc_id", "text").collect():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want.update((d, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert packing.assign(packing.pieces(nothing, BYTE, 0)).count() == 0


def test_plan_uses_every_piece_once():
    rnd = random.Random(2)
    for _ in range(5):
        histogram = Counter(min(64, int(rnd.expovariate(0.05)) + 1) for _ in range(rnd.randrange(1, 3000)))
        runs = packing.plan(dict(histogram), 64)
        used = Counter()
        for pattern, repeats in runs:
            assert sum(pattern) <= 64 and repeats > 0
            used.update({x: n * repeats for x, n in Counter(pattern).items()})
        assert used == histogram
        total = sum(n for _, n in runs)
        assert total <= sum(n for _, n in packing.best_fit(dict(histogram), 64)) and total >= -(-sum(k * v for k, v in histogram.items()) // 64)


def test_shards(awkward, nothing, tmp_path):
    shards = sstable.write_shards(awkward, WORD, 1, folder=f"file://{tmp_path}/t")
    got = sorted(rows(sstable.read_shards(shards)), key=lambda r: r[1])
    library = Tokenizer.from_file(WORD)
    docs = sorted(awkward.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for (d, text), r in zip(docs, got, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert r == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    found = [sstable.Reader(p["path"]) for p in shards.manifest.collect()]
    hits = lambda d: sum(len(r.get(sstable.integer_key(d))) for r in found)
    assert (hits(2), hits(7), hits(None), hits(99), hits(-5)) == (2, 1, 1, 0, 0)
    assert sstable.read_shards(sstable.write_shards(nothing, WORD, 1)).count() == 0


def test_shard_format_round_trip(tmp_path):
    keys = sorted(sstable.integer_key(k) for k in [None, -(1 << 63), -5, 0, 3, 3, (1 << 63) - 1, *range(10, 2000, 7)])
    writer = sstable.Writer(open(tmp_path / "a.sst", "wb"), 2, block_bytes=256)
    values = [np.arange(k % 50, dtype="<u2") for k in range(len(keys))]
    for k, v in zip(keys, values, strict=True):
        writer.add(k, v.tobytes())
    writer.close()
    reader = sstable.Reader(f"file://{tmp_path}/a.sst")
    assert [(k, v.tolist()) for k, v in reader.scan()] == [(k, v.tolist()) for k, v in zip(keys, values, strict=True)] and len(reader.blocks) > 5
    assert all(values[keys.index(k)].tolist() in [v.tolist() for v in reader.get(k)] for k in keys)
    assert len(reader.get(sstable.integer_key(3))) == 2 and reader.get(sstable.integer_key(11)) == []
    with pytest.raises(ValueError):
        writer = sstable.Writer(open(tmp_path / "b.sst", "wb"), 2)
        writer.add(b"b", b"")
        writer.add(b"a", b"")


# ------------------------------------------------------------------ 7 SimHash
def simhash_reference(text, n=4):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(awkward, nothing):
    got = simhash.near_duplicates(awkward).collect()
    texts = awkward.select("doc_id", "text").collect()
    want = {d: simhash_reference(t) for d, t in texts if d != 7}
    assert all(r["fp"] % (1 << 64) == want[r["doc_id"]] for r in got if r["doc_id"] != 7) and len(got) == len(texts)
    groups = {r["doc_id"]: r["component_id"] for r in got}
    assert groups[1] == groups[2] == 1 and groups[3] == groups[4] == groups[5] == 3 and groups[7] == 7 and groups[None] is None
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize(("hot", "short"), [(100_000, 32), (20, 32), (20, 2)])
def test_links_and_components(spark, monkeypatch, hot, short):
    """hot 20: lists are split by further positions; short 2: longer ones give a forest."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "SHORT", short)
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:10]:  # chains of near ones
        for _ in range(30):
            b ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
            prints.add(b)
    prints |= {rnd.getrandbits(40) for _ in range(300)}  # many that share three bytes
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"))
    roots = dict(rows(components(edges)))
    listed = np.array(sorted(prints), np.uint64)
    parent = list(range(len(listed)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(listed)):
        for j in np.flatnonzero(np.bitwise_count(listed[i + 1 :] ^ listed[i]) <= 4):
            parent[find(i + 1 + int(j))] = find(i)
    want, have = {}, {}
    for i, p in enumerate(listed.view(np.int64).tolist()):
        want.setdefault(find(i), set()).add(p)
        have.setdefault(roots.get(p, p), set()).add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_tally_of_shared_bytes():
    rnd = random.Random(11)
    pairs = [(rnd.getrandbits(64), rnd.getrandbits(64) if rnd.random() < 0.3 else None) for _ in range(500)]
    pairs = [(a, a ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(6))) % (1 << 64) if b is None else b) for a, b in pairs]
    x = np.array([a ^ b for a, b in pairs], np.uint64)
    want = [sum(p == q for p, q in zip(a.to_bytes(8), b.to_bytes(8), strict=True)) for a, b in pairs]
    assert simhash.shared_bytes(x).tolist() == want
    assert simhash.links_of(x, 4).tolist() == [(a ^ b).bit_count() <= 4 for a, b in pairs]


def test_positions_follow_the_number_of_fingerprints():
    assert [simhash.positions_for(n) for n in (0, 1 << 20, (1 << 20) + 1, 1 << 28, (1 << 28) + 1, 1 << 40)] == [2, 2, 3, 3, 4, 4]


def test_forest_of_a_crowded_key(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 50)  # forces the inner index
    rnd = random.Random(8)
    found = np.unique(np.array([rnd.getrandbits(20) << 13 for _ in range(600)], np.uint64))
    near = lambda a, b: np.bitwise_count(a ^ b) <= 4

    def classes(pairs):
        label = {int(x): int(x) for x in found}
        for _ in range(len(found)):
            moved = False
            for a, b in pairs:
                low = min(label[a], label[b])
                if label[a] != low or label[b] != low:
                    label[a] = label[b] = low
                    moved = True
            if not moved:
                break
        return label

    left, right = simhash.forest(found, 4)
    every = [(int(found[i]), int(found[j])) for i in range(len(found)) for j in np.flatnonzero(near(found[i + 1 :], found[i])) + i + 1]
    assert all(near(left, right)) and classes(list(zip(left.tolist(), right.tolist(), strict=True))) == classes(every)


def test_similar_documents(spark, awkward, nothing):
    rnd = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(150, 400))] for _ in range(40)]
    docs = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(20):  # copies with few words changed: similarity over 0.9
        w = list(base[k])
        for _ in range(max(1, len(w) // 200)):
            w[rnd.randrange(len(w))] = "changed"
        docs.append((100 + k, " ".join(w)))
    docs += [(200 + k, " ".join(base[k][: len(base[k]) // 2] + [rnd.choice(vocabulary) for _ in range(200)])) for k in range(20, 40)]  # half in common
    docs += [(300 + k, docs[5][1].upper()) for k in range(60)]  # many copies
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert all(got[100 + k] == k for k in range(20)) and all(got[300 + k] == 5 for k in range(60))
    assert all(got[k] == k for k in range(40)) and all(got[200 + k] == 200 + k for k in range(20, 40))
    groups = [(r["doc_id"], r["component_id"]) for r in similar.similar_documents(awkward).collect()]
    assert len(groups) == awkward.count() and dict(groups)[2] == 1 and dict(groups)[4] == dict(groups)[5] == 3 and dict(groups)[10] == 10
    assert similar.similar_documents(nothing).count() == 0


def shingle_sets(docs, n=5):
    return {d: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for d, text in docs if (w := words((text or "").lower()))}


def jaccard_groups(docs, p=4, q=5):
    """Smallest id of every document's group, by comparing all pairs."""
    sets, least = shingle_sets(docs), {d: d for d, _ in docs}

    def top(d):
        while least[d] != d:
            d = least[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if q * both >= p * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                least[high] = low
    return {d: top(d) for d, _ in docs}


def similar_groups(spark, docs):
    found = similar.similar_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4))
    return {r["doc_id"]: r["component_id"] for r in found.collect()}


def test_near_copies_link_by_fingerprint_first(spark, monkeypatch):
    """SimHash comes first: what it links is not decided again by lists of shingles, and
    these settle what it leaves."""
    rnd = random.Random(5)
    docs = [(k, " ".join(f"s{rnd.randrange(10**9)}" for _ in range(600))) for k in range(40)]
    docs += [(100 + k, docs[k][1] + " end") for k in range(30)] + [(200 + k, docs[k][1].replace(" ", " x ", 10)) for k in range(5)]
    seen, decided = [], similar._decided

    def kept(pairs, *others):
        out = decided(pairs, *others)
        seen.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(similar, "_decided", kept)
    assert similar_groups(spark, docs) == jaccard_groups(docs)
    assert seen[0][1] >= 25 and seen[1][0] <= 10


@pytest.mark.parametrize("crowd", [6, 120])
def test_copies_beside_a_merely_similar_hub(spark, crowd):
    """True copies meet texts of smaller id that share much with all of them and are copies of none."""
    rnd = random.Random(crowd)
    fresh = lambda n: [f"v{rnd.randrange(10**9)}" for _ in range(n)]
    shared = fresh(200)
    docs = [(0, " ".join(shared + fresh(50)))]
    for _ in range(crowd // 2):
        own = fresh(45)
        docs += [(len(docs), " ".join(shared + own)), (len(docs) + 1, " ".join(shared + own + fresh(36)))]
    want = jaccard_groups(docs)
    assert len(set(want.values())) == 1 + crowd // 2 and similar_groups(spark, docs) == want


def test_pairs_near_the_threshold_equal_brute_force(spark):
    """Pairs of Jaccard about 0.7 to 0.95: all of 0.8 or more group and none below."""
    rnd = random.Random(21)
    docs = []
    for k in range(150):
        w = [f"u{rnd.randrange(10**6)}" for _ in range(rnd.choice((40, 220, 225)))]
        docs.append((2 * k, " ".join(w)))
        for at in rnd.sample(range(3, len(w) - 3), max(1, rnd.randrange(3, 8) * len(w) // 220)):
            w[at] = f"x{rnd.randrange(10**6)}"
        docs.append((2 * k + 1, " ".join(w)))
    want = jaccard_groups(docs)
    assert 160 < len(set(want.values())) < 290 and similar_groups(spark, docs) == want


# ------------------------------------------------------------------ 8 substring dedup
def repeats_reference(docs, window):
    first = {}
    for d, text in docs:
        w = words(text)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, 1 << 70), (1 << 63) - 1 if d is None else d)
    out = []
    for d, text in docs:
        w, me = words(text), (1 << 63) - 1 if d is None else d
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < me for j in range(window)}
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_repeats(awkward, nothing):
    docs = rows(awkward.select("doc_id", "text"))
    got = rows(substring.remove_repeats(awkward, carry=("key",)).select("doc_id", "n_words", "n_removed", "kept"))
    assert sorted(map(str, got)) == sorted(map(str, repeats_reference(docs, 13)))
    assert substring.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("hot", [10_000, 3])
def test_repeats_of_random_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_FRAGMENTS", hot)  # 3: anchors are split by window
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)
    rnd = random.Random(hot)
    shared = [[rnd.choice("abcdefgh") for _ in range(rnd.randrange(4, 40))] for _ in range(12)]
    docs = []
    for d in range(120):
        w = []
        for _ in range(rnd.randrange(0, 5)):
            w += rnd.choice(shared) if rnd.random() < 0.7 else [rnd.choice("ijklmnop") for _ in range(rnd.randrange(12))]
        docs.append((d % 100, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = rows(substring.remove_repeats(df, window=6, gram=3))
    assert sorted(got) == sorted(repeats_reference(docs, 6))


def test_repeats_of_rows_without_or_with_equal_ids(spark):
    """Many rows of one id and of none: each text is judged by itself."""
    rnd = random.Random(17)
    shared = [[f"s{rnd.randrange(10**6)}" for _ in range(20)] for _ in range(6)]
    text = lambda k: " ".join(rnd.choice(shared) + [f"o{k}x{j}" for j in range(rnd.randrange(15))] + rnd.choice(shared))
    docs = [(None, text(k)) for k in range(60)] + [(5, text(100 + k)) for k in range(60)] + [(9, text(200))] + [(k, text(k)) for k in range(10, 30)]
    docs += docs[:10] + docs[60:70] + [(None, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    assert sorted(map(str, rows(substring.remove_repeats(df)))) == sorted(map(str, repeats_reference(docs, 13)))


@pytest.mark.parametrize("window", [5, 40, 70])
def test_repeats_of_other_windows(spark, window):
    rnd = random.Random(window)
    shared = [[rnd.choice("abcdefgh") for _ in range(rnd.randrange(30, 160))] for _ in range(4)]
    docs = [(d, " ".join(rnd.choice(shared) + [str(rnd.random())] + rnd.choice(shared)[: rnd.randrange(200)])) for d in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    whole = substring.remove_repeats(df, window=window, untouched=True).collect()
    want = {d: (n, gone, kept) for d, n, gone, kept in repeats_reference(docs, window)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in whole} == want


def test_wavelet_matrix():
    rnd = random.Random(2)
    values = np.array([rnd.randrange(37) for _ in range(700)])
    matrix = WaveletMatrix(values, 37)
    at = np.array([rnd.randrange(701) for _ in range(300)])
    symbol = np.array([rnd.randrange(37) for _ in range(300)])
    assert (matrix.walk(symbol, at) - matrix.walk(symbol, 0 * at)).tolist() == [int((values[:a] == s).sum()) for a, s in zip(at, symbol, strict=True)]
    low, high = np.minimum(at, at[::-1]), np.maximum(at, at[::-1]) + 1
    high = np.minimum(high, 700)
    some = low < high
    assert matrix.least(low[some], high[some]).tolist() == [int(values[a:b].min()) for a, b in zip(low[some], high[some], strict=True)]


def test_fm_index():
    rnd = random.Random(1)
    text = np.array([rnd.randrange(1, 5) if rnd.random() < 0.9 else 0 for _ in range(600)] + [0])
    document = np.array([rnd.randrange(9) for _ in text])
    want = sorted(range(len(text)), key=lambda k: text[k:].tolist())
    assert suffix_order(text, 1000).tolist() == want
    assert [text[k : k + 9].tolist() for k in suffix_order(text, 9)] == sorted(text[k : k + 9].tolist() for k in want)
    streamed = np.array([rnd.randrange(1, 7) if rnd.random() < 0.1 else int(rnd.choice(text[text > 0])) for _ in range(400)])
    for fm in (FMIndex(text, document), FMIndex(text, document, 9)):
        assert not hasattr(fm, "text") and fm.words.nbytes() < 4 * len(text)
        for pattern, alone in ((text, 1), (streamed, 0)):
            starts = np.array([k for k in range(len(pattern) - 8) if pattern[k : k + 8].all()])  # patterns hold no separator
            matched, low, high = fm.matching(pattern, starts, 8, alone)
            for i, k in enumerate(starts.tolist()):
                hits = [j for j in range(len(text)) if text[j : j + 8].tolist() == pattern[k : k + 8].tolist()]
                assert (matched[i] == 8) == (len(hits) > alone)
                if len(hits) > alone:
                    assert high[i] - low[i] == len(hits) and fm.earliest(low[i : i + 1], high[i : i + 1])[0] == min(document[hits])
                n = int(matched[i])
                assert n == 0 or sum(text[j : j + n].tolist() == pattern[k + 8 - n : k + 8].tolist() for j in range(len(text) - n + 1)) > alone


# ------------------------------------------------------------------ 10 language
def test_language(awkward, nothing):
    docs = {r["doc_id"]: r for r in langid.predict(awkward, langid.train(awkward), carry=("doc_id", "key")).collect()}
    assert all(docs[d]["lang_pred"] == "und" and docs[d]["rejected"] and docs[d]["score"] == 0 for d in (3, 4, 5, 6))
    assert docs[10]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in docs.values())
    assert langid.train(nothing) == {} and langid.predict(nothing, {}).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs, langid.train(docs), carry=("doc_id", "lang")).withColumn("held", langid.held_out(F.col("doc_id")))
    right = found.filter("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    assert all(r["held"] == langid.is_held_out(r["doc_id"]) for r in found.limit(50).collect())


def test_only_letters_count(spark):
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(["½ ² ① Ⅷ", "٣ 12 _", "一", "ª", "x½", "\u0301"])], "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, {"aa": b"some words of one", "bb": b"andere rede dort"}).collect()}
    assert [found[k] == "und" for k in range(6)] == [True, True, False, False, False, True]
    assert langid.normalise("A½B_c٣Ⅷ d") == "a b c d"


def test_every_label_is_learned(spark):
    learned = [k for k in range(2000) if not langid.is_held_out(k)][:250]
    rows_ = [(k, f"text of number {k}", f"l{n}") for n, k in enumerate(learned)] + [(None, "a text without an id " + "x" * (j % 7), "none") for j in range(3000)]
    found = langid.train(spark.createDataFrame(rows_, "doc_id bigint, text string, lang string").repartition(4), langid.Params(sample_docs=5))
    assert len(found) == 251 and len(found["none"]) <= 5 * 60


def test_language_equals_plain_compression(spark):
    import unicodedata

    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    params = langid.Params()
    learned = sorted(langid.train(docs, params).items())
    for r in langid.predict(docs, dict(learned), params, carry=("text",)).collect():
        letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (r["text"] or "").lower())
        clean = " ".join(letters.split())
        if not clean:
            assert r["lang_pred"] == "und"
            continue
        if len(clean) < params.repeat_to:
            clean = " ".join([clean] * (1 + params.repeat_to // (1 + len(clean))))
        sizes = []
        for _, raw in learned:
            primed = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=params.level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(coder.compress(clean[at : at + params.piece_chars].encode())) for at in range(0, len(clean), params.piece_chars)))
        best, second = sorted(sizes)[:2]
        assert r["lang_pred"] == learned[sizes.index(best)][0] and abs(r["margin"] - (second - best) / second) < 1e-12 and r["rejected"] == (r["margin"] < params.min_margin)


def test_training_ignores_held_out_rows(spark):
    d = next(k for k in range(100) if langid.is_held_out(k))
    docs = spark.createDataFrame([(d, "zzz qqq", "xx"), (d + 1, "der und die", "de")], "doc_id bigint, text string, lang string")
    assert set(langid.train(docs)) == {x for x in ("xx", "de") if not langid.is_held_out(d if x == "xx" else d + 1)}


# ------------------------------------------------------------------ 2 chat
def test_chat_round_trip(spark):
    texts = [None, "", "plain", "</s>[INST] ok [/INST]", "<\\/s> <|im_end|> <\\\\|im_start|>", "a\n<|im_start|>user\nb", "<", "<<SYS>>[\\INST]", "\U0001f600́"]
    turns = [(c, t, role, texts[(c * 7 + t) % len(texts)], t) for c in range(20) for t, role in enumerate(["system", "user", "assistant", "we\nird", None, "assistant"][: c % 7])] + [(None, 1, "user", "null id", 1), (3, 1, "user", "repeat", 1), (3, None, "assistant", "no turn", 0)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, place int").repartition(4)
    shown = chat.render(chat.fold(chat.log_of_turns(df)), segment_chars=60)
    got = {r["conv_id"]: r for r in chat.read_back(shown).collect()}
    by = {}
    for c, t, role, text, _ in turns:
        by.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert got.keys() == by.keys() and max(r["n_segments"] for r in got.values()) > 1
    for c, said in by.items():
        said.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in said)
        learned = "".join(x for _, r, x in said if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_back(chat.render(chat.fold(chat.log_of_turns(df.filter("1 = 0"))))).count() == 0


def test_streamed_log_folds_to_the_turns(spark):
    """Deltas, edits and regenerations: the log differs, the messages do not."""
    texts = [None, "", "x", "word " * 40, "\U0001f600" * 97, "</s>" * 30]
    turns = [(c, t, ["user", "assistant", None][(c + t) % 3], texts[(c * 5 + t) % len(texts)]) for c in range(30) for t in range(c % 9)] + [(None, 1, "assistant", "null id " * 20)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    log = chat.log_of_turns(df, streamed=True).cache()
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    order = ["conv_id", "place"]
    assert rows(chat.fold(log).orderBy(order)) == rows(chat.fold(chat.log_of_turns(df)).orderBy(order))


def test_chat_events(spark):
    log = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", "he"), (1, 3, "delta", 1, "assistant", "llo"), (1, 4, "delta", 1, None, " you"),
        (1, 5, "message", 2, "user", "more"), (1, 6, "edit", 0, "user", "hi!"), (1, 7, "regenerate", 1, None, None), (1, 8, "message", 1, "assistant", "new"), (1, 9, "delta", 1, "assistant", "er"),
        (2, 1, "delta", 0, "assistant", "only"), (2, 2, "delta", 0, "assistant", None),
    ]
    got = rows(chat.fold(spark.createDataFrame(log, "conv_id int, seq int, kind string, place int, role string, text string")).orderBy("conv_id", "place"))
    assert got == [(1, 0, "user", "hi!"), (1, 1, "assistant", "newer"), (2, 0, "assistant", "only")]


def test_escape_is_reversible():
    rnd = random.Random(3)
    parts = [*chat.CONTROLS, "\\", "<", "[", "s>", "|im_end|>", "x", "\n"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(8)))
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)
        assert list(chat.parse(f"{chat.OPEN}{chat.escape_role(t)}\n{chat.escape(t)}{chat.CLOSE}\n")) == [(t, t)]


# ------------------------------------------------------------------ 4 top-k
def topk_reference(data, k=5):
    """All pairs in Python's whole numbers; scores are shown within 64 bits."""
    whole = lambda x: math.floor(x * 256) if abs(x) < 2**52 else int(x) * 256
    good = [(d, [whole(x) for x in v]) for d, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, (d, v) in enumerate(good):
        if d is not None and d % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), o is None, o or 0) for j, (o, w) in enumerate(good) if j != i and len(w) == len(v))[:k]
            want += [(d, n + 1, None if none else o, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, none, o) in enumerate(scored)]
    return want


def as_floats(data):
    return [(d, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for d, v in data]


@pytest.mark.parametrize("cut", [4096, 16])
def test_topk(spark, monkeypatch, cut):
    for name in ("BLOCK", "QUERIES", "BOUNDED"):
        monkeypatch.setattr(topk, name, cut)  # 16: many blocks and slices
    rnd = random.Random(6)
    vec = lambda d: [rnd.choice([-1.0, 0.5, 0.1, 2.0]) * rnd.random() for _ in range(d)]
    data = [(k, vec(6)) for k in range(300)] + [(10, [0.25] * 6), (300, [0.25] * 6), (301, [0.25] * 6), (302, None), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (306, vec(3)), (310, vec(3)), (None, vec(6)), (320, []), (321, []), (None, []), (330, [0.0] * 6)]
    data += [(400 + k, [0.5, -0.5, 0.25, 1.0, 0.0, 2.0]) for k in range(40)]  # a group of copies
    data = as_floats(data)
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in data], "vec_id bigint, embedding array<float>, uid string, block int").repartition(4)
    assert sorted(map(str, rows(topk.top_k(df, F.col("vec_id") % 10 == 0, k=5)))) == sorted(map(str, topk_reference(data)))
    assert topk.top_k(df.filter("1 = 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [1e3, 1e6, 3e9, 1e30, 3e38])
def test_topk_of_large_components(spark, size):
    """Exact order where scores pass what doubles or 64 bits hold."""
    rnd = random.Random(int(math.log10(size)))
    data = [(k, [size * rnd.uniform(-1, 1) for _ in range(4)]) for k in range(120)]
    data += [(200 + k, [x * (1 + 2**-20 * j) for j, x in enumerate(data[k][1])]) for k in range(30)] + [(300, [0.25] * 4), (310, [100000.0, 0.0, 0.0, 0.0]), (320, [70000.0, 0.0, 0.0, 0.0])]
    data = as_floats(data)
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").repartition(3)
    assert sorted(rows(topk.top_k(df, F.col("vec_id") % 10 == 0, k=5))) == sorted(topk_reference(data))


def test_bounds_hold():
    rnd = np.random.default_rng(3)
    for size in (3.0, 1e4, 1e9, 1e14):
        v, q = np.floor(rnd.normal(0, size, (200, 8))), np.floor(rnd.normal(0, size, (20, 8)))
        a = topk.Approximation.of(np.arange(200), np.arange(200), v)
        lower, upper = a.bounds(q)
        for i in range(20):
            for n in range(200):
                whole = sum(int(x) * int(y) for x, y in zip(q[i], v[n], strict=True))
                assert lower[i, n] <= whole <= upper[i, n]


# ------------------------------------------------------------------ 1 mixing
def test_mix(spark, awkward, nothing):
    mixture = mixing.Mixture({"src0": "a", "src1": "a", "src2": "b"}, {"a": 3, "b": 1}, budget=(1, 2), max_epochs=3)
    got = mixing.mix(awkward, mixture).collect()
    tokens = {}
    for r in awkward.collect():
        key = ({"src0": "a", "src1": "a", "src2": "b"}.get(r["source"], "other"), r["lang"] or mixing.NONE, r["source"] or mixing.NONE)
        tokens[key] = tokens.get(key, 0) + len(words(r["text"]))
    used = Counter()
    for r in got:
        used[(r["domain"], r["lang"], r["source"])] += r["n_tokens"]
    assert sum(used.values()) <= sum(tokens.values()) // 2 and all(used[k] <= 3 * tokens[k] for k in used)
    assert mixing.mix(nothing, mixture).count() == 0
    carried = mixing.mix(awkward, mixture, carry=("text", "key"))
    assert sorted(str((r["doc_id"], r["epoch"])) for r in carried.collect()) == sorted(str((r["doc_id"], r["epoch"])) for r in got)


def shares_reference(children, budget):
    """Water filling in whole numbers: (name, weight, capacity)."""
    out, open_ = {n: c if w == 0 and False else 0 for n, w, c in children}, [(n, w, c) for n, w, c in children if w > 0]
    left = budget
    while open_:
        total = sum(w for _, w, _ in open_)
        full = [(n, w, c) for n, w, c in open_ if c * total <= left * w]
        if not full:
            for n, w, _ in open_:
                out[n] = w * left // total
            break
        n, w, c = min(full, key=lambda x: (x[2] / x[1], x[0]))
        out[n] = c
        left -= c
        open_.remove((n, w, c))
    return out


def test_shortages_go_to_siblings_first(spark):
    rnd = random.Random(9)
    for trial in range(6):
        leaves = [(d, g, f"s{k}", rnd.choice([0, 1, 5, 50, 400])) for d in "ab" for g in ("x", "y") for k in range(3)]
        weights = {d: rnd.randrange(0, 4) for d in "ab"}
        langs = {d: {g: rnd.randrange(1, 4) for g in ("x", "y")} for d in "ab"}
        m = mixing.Mixture({}, weights, langs, budget=(rnd.randrange(1, 6), 4), max_epochs=2)
        got = {tuple(r[:3]): r["share"] for r in mixing.allocate(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint"), m).collect()}
        cap = {(d, g, s): 2 * n if weights[d] else 0 for d, g, s, n in leaves}
        budget = sum(x[3] for x in leaves) * m.budget[0] // m.budget[1]
        top = shares_reference([(d, weights[d], sum(c for k, c in cap.items() if k[0] == d)) for d in "ab"], budget)
        for d in "ab":
            mid = shares_reference([(g, langs[d][g], sum(c for k, c in cap.items() if k[:2] == (d, g))) for g in ("x", "y")], top[d])
            for g in ("x", "y"):
                low = shares_reference([(s, 1, cap[d, g, s]) for s in ("s0", "s1", "s2")], mid[g])
                assert {s: got[d, g, s] for s in low} == low, trial


# ------------------------------------------------------------------ similarity: bitmaps
def test_bitmaps_never_exceed_the_difference():
    rnd = np.random.default_rng(5)
    for n in (1, 30, 32, 33, 700):
        a = np.unique(rnd.integers(-(2**62), 2**62, n))
        b = np.unique(np.concatenate([a[: n - n // 7], rnd.integers(-(2**62), 2**62, n // 6)]))
        lanes = similar.lanes_for(len(a))
        assert 64 * lanes >= 2 * len(a) and lanes.bit_count() == 1
        x, y = similar.parities(a, lanes), similar.parities(b, lanes)
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
        if lanes > 1:
            assert (x[: lanes // 2] ^ x[lanes // 2 :]).tolist() == similar.parities(a, lanes // 2).tolist()
