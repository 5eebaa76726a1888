"""The registered queries: each applies one operator to its whole table.

A query is thin: it calls its operator and derives the columns of its result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import chat, langid, mixing, packing, periodic, quality, simhash, spotsigs, sstable, substring, token_count, topk, trie
from sextant.llm.common import let, table, words_of


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _quality_sql() -> str:
    """The rule table in DuckDB SQL, from the same thresholds."""
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    checks = []
    for r in quality.RULES:
        if r.low is not None:
            checks.append(f"({r.denominator} = 0 OR {r.numerator}::DOUBLE >= {r.denominator}::DOUBLE * {r.low}::DOUBLE)")
        if r.high is not None:
            checks.append(f"({r.denominator} = 0 OR {r.numerator}::DOUBLE <= {r.denominator}::DOUBLE * {r.high}::DOUBLE)")
    failed = f"(n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)"
    return f"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
      FROM documents),
    win AS (
      SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM d)),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range({quality.WINDOW}) AS r(k) GROUP BY doc_id),
    m AS (
      SELECT d.doc_id, len(w) AS n_words, coalesce(len(array_to_string(w, '')), 0) AS word_chars,
             len(regexp_extract_all(t, '{quality.SYMBOLS}')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
             len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words,
             len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines
      FROM d LEFT JOIN cov USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           {failed} AS base_failed, NOT {failed} AND {" AND ".join(checks)} AS kept
    FROM m"""


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def _mix_sql(m: mixing.Mixture) -> str:
    def case(table: dict, name: str, default: object) -> str:
        quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
        whens = " ".join(f"WHEN {name} = '{k}' THEN {quote(v)}" for k, v in table.items())
        return f"CASE {whens} ELSE {quote(default)} END" if whens else quote(default)

    def nested(tables: dict, name: str) -> str:
        whens = " ".join(f"WHEN domain = '{d}' THEN {case(t, name, m.default)}" for d, t in tables.items())
        return f"CASE {whens} ELSE {m.default} END" if whens else str(m.default)

    def share(source: str, parent: str, name: str) -> str:
        """Shares of the children in source (parent, name, weight, capacity, budget)."""
        return f"""
      SELECT {parent}, {name}, CASE WHEN is_full THEN capacity ELSE (weight * (budget - taken) // open)::BIGINT END AS share
      FROM (SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY {parent}) AS taken,
                   sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open
            FROM (SELECT *, up_c * weight + capacity * (all_w - up_w) <= budget::HUGEINT * weight AS is_full
                  FROM (SELECT *, sum(weight) OVER (PARTITION BY {parent}) AS all_w,
                               sum(capacity) OVER u AS up_c, sum(weight) OVER u AS up_w
                        FROM (SELECT *, CASE WHEN weight > 0 THEN capacity::DOUBLE / weight ELSE 0 END AS level FROM {source})
                        WINDOW u AS (PARTITION BY {parent} ORDER BY level, {name} ROWS UNBOUNDED PRECEDING))))"""

    key = f"('0x' || substr(md5('{m.seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '{mixing.NONE}')), 1, 15))::BIGINT"
    return f"""
    WITH docs AS (
      SELECT doc_id, coalesce(lang, '{mixing.NONE}') AS lang, coalesce(source, '{mixing.NONE}') AS source,
             {case(m.domains, f"coalesce(source, '{mixing.NONE}')", m.other)} AS domain,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
      FROM documents),
    leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
    weighted AS (
      SELECT *, 0 AS root, {case(m.domain_weights, "domain", m.default)} AS wd, {nested(m.language_weights, "lang")} AS wl,
             {nested(m.source_weights, "source")} AS ws FROM leaf),
    capped AS (SELECT *, CASE WHEN wd > 0 AND wl > 0 AND ws > 0 THEN tokens * {m.max_epochs} ELSE 0 END AS cap FROM weighted),
    d_in AS (
      SELECT root, domain, max(wd) AS weight, sum(cap) AS capacity,
             (SELECT sum(tokens) * {m.budget[0]} // {m.budget[1]} FROM leaf) AS budget FROM capped GROUP BY root, domain),
    d AS ({share("d_in", "root", "domain")}),
    l_in AS (
      SELECT c.domain, c.lang, max(wl) AS weight, sum(cap) AS capacity, max(d.share) AS budget
      FROM capped c JOIN d ON c.domain = d.domain GROUP BY c.domain, c.lang),
    l AS ({share("l_in", "domain", "lang")}),
    s_in AS (
      SELECT c.domain, c.lang, c.domain || '/' || c.lang AS node, c.source, ws AS weight, cap AS capacity, l.share AS budget
      FROM capped c JOIN l ON c.domain = l.domain AND c.lang = l.lang),
    s AS ({share("s_in", "node", "source")}),
    plan AS (
      SELECT leaf.*, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS rest
      FROM leaf JOIN s ON s.node = leaf.domain || '/' || leaf.lang AND s.source = leaf.source),
    keyed AS (SELECT docs.*, epochs, rest, {key} AS key FROM docs JOIN plan USING (domain, lang, source)),
    summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed),
    times AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM summed)
    SELECT doc_id, domain, lang, source, n_tokens, unnest(range(times::BIGINT))::INT AS epoch FROM times WHERE times > 0"""


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    planted = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(chat.LEARNED_ROLE).alias("role"), said.alias("text")
    )
    return chat.read_back(chat.render(chat.fold(chat.log_of_turns(turns.unionByName(planted), streamed=True)))).drop("n_segments")


def _chat_sql() -> str:
    rest = "|".join(re.escape(c[1:]).replace("'", "''") for c in chat.CONTROLS)
    escaped = rf"regexp_replace(text, '([<\[])(\\*)({rest})', '\1\\\2\3', 'g')"
    frame = len(chat.OPEN) + len(chat.CLOSE) + 2
    return f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -1, 1, '{chat.LEARNED_ROLE}', '</s>[INST] ok [/INST]'),
    x AS (SELECT *, CASE WHEN role = '{chat.LEARNED_ROLE}' THEN text END AS learned, {escaped} AS shown FROM t)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(learned)), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(learned, '' ORDER BY turn, role, text), '')) AS loss_sha256,
           sum(length(role) + length(shown) + {frame})::BIGINT AS formatted_chars
    FROM x GROUP BY conv_id"""


def op4_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


_TOPK_SQL = """
    WITH v AS (
      SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
      FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 50 = 0)
    SELECT query_id, rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5"""


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.assign(digests)


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sstable.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return sstable.read_shards(shards)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.withColumn("held_out", langid.held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def _crc32(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def _with_planted_run(doc_id: Column, text: Column) -> Column:
    """The text, a tenth of them with a run planted by the id's checksum."""
    g = F.floor(_crc32(doc_id) / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.transform(F.sequence(a, n - 1), lambda i: words[a + (i - a) % p])
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise("")

    return F.when(_crc32(doc_id) % 10 == 0, let(words_of(text), planted)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic.find_runs(docs.select("doc_id", _with_planted_run(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("r", longest)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "r.start", "r.length", "r.period",
        F.floor(1000 * F.col("r.length") / F.col("r.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def _shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt, as ``conv_id, place, label, n_bytes``, and their ids: c has
    the first h turns of c - c % 5, then its own after its first h."""
    own = trie.numbered(turns)
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.coalesce(_crc32(F.col("conv_id")) % 9, F.lit(0))
    ids = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    ids = ids.join(base, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_n", F.lit(0))))
    opening = own.filter("place <= 8").withColumnRenamed("conv_id", "base")
    shared = ids.select("conv_id", "base", "h").join(opening, "base").filter("place <= h").select("conv_id", "place", "label", "n_bytes")
    of = ids.select(F.col("conv_id").alias("of"), "h", "shared")
    kept = own.join(of, F.col("conv_id").eqNullSafe(F.col("of"))).filter("place > h")
    kept = kept.select("conv_id", (F.col("place") - F.col("h") + F.col("shared")).cast("int").alias("place"), "label", "n_bytes")
    return shared.unionByName(kept), ids.select("conv_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*_shared_openings(table(spark, sf_dir, "conversations")))


_CRC_BYTE = "list_concat([ascii(x)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])"
_CRC_SQL = f"""xor(4294967295::BIGINT, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: {_CRC_BYTE}))),
        lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
_TRIE_SQL = f"""
    WITH lab AS (
      SELECT conv_id, turn, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
             md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS label
      FROM conversations),
    own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, label) AS place FROM lab),
    sizes AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
    ids AS (
      SELECT s.conv_id, s.h, s.conv_id - s.conv_id % 5 AS base, least(s.h, coalesce(b.n, 0)) AS shared
      FROM (SELECT *, {_CRC_SQL} % 9 AS h FROM sizes) s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 5),
    built AS (
      SELECT i.conv_id, place, label, n_bytes FROM ids i JOIN own o ON o.conv_id = i.base WHERE place <= h
      UNION ALL
      SELECT i.conv_id, place - h + shared, label, n_bytes FROM ids i JOIN own o ON o.conv_id = i.conv_id WHERE place > h),
    p AS (
      SELECT conv_id, place AS depth, n_bytes, string_agg(label, ',') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS key FROM built
      UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
    node AS (SELECT key, depth, count(*) AS n_convs, min(conv_id) AS conv_id, any_value(n_bytes) AS n_bytes FROM p GROUP BY key, depth),
    up AS (SELECT n.*, p.key AS parent FROM node n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
    children AS (SELECT parent, count(*) AS n FROM up WHERE depth > 0 GROUP BY parent),
    full_ AS (SELECT up.*, coalesce(c.n, 0) AS n_children FROM up LEFT JOIN children c ON c.parent = up.key),
    sums AS (
      SELECT p.key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.n_bytes)::BIGINT AS saved
      FROM full_ f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.key),
    last AS (SELECT conv_id, max_by(key, depth) AS key FROM p GROUP BY conv_id),
    ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS members FROM last GROUP BY key)
    SELECT f.conv_id, f.depth::BIGINT AS depth, pn.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
           s.n_leaves, s.saved AS saved_tokens, sha256(coalesce(e.members, '')) AS ends_sha256
    FROM full_ f JOIN sums s ON s.key = f.key LEFT JOIN node pn ON pn.key = f.parent AND f.depth > 0 LEFT JOIN ends e ON e.key = f.key"""


def op13_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))
    return f.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spotsigs.fingerprint(F.col("found")).alias("fingerprint"), spotsigs.fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("found"), F.col("edited_found")).alias("near_edited"), spotsigs.likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )


def _spot_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

    def found(text: str) -> str:
        hashed = lambda *parts: f"substr(md5(concat_ws(' ', {', '.join(parts)})), 1, {spotsigs.DIGITS})"
        spot = hashed("w[i]", "c[i + 1]", f"list_filter(c[i + 2:i + {spotsigs.REACH}], lambda x: x IS NOT NULL)[1]")
        every = hashed("w[i]", "w[i + 1]", "w[i + 2]")
        return f"""(
      SELECT uid, list_sort(list_distinct(CASE WHEN len(spots) > 0 THEN list_transform(spots, lambda i: {spot}) ELSE list_transform(range(1, len(w) + 1), lambda i: {every}) END)) AS found
      FROM (SELECT *, list_filter(range(1, len(w)), lambda i: c[i] IS NULL AND c[i + 1] IS NOT NULL) AS spots
            FROM (SELECT *, list_transform(w, lambda x: CASE WHEN x IN ({stop}) THEN NULL ELSE x END) AS c
                  FROM (SELECT uid, regexp_extract_all(lower({text}), '[^\x20\x09-\x0D]+') AS w FROM d))))"""

    def likeness(a: str, b: str) -> str:
        jaccard = f"len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
        return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN {jaccard} >= {spotsigs.LEAST}::DOUBLE THEN {jaccard} ELSE 0.0 END::DOUBLE"

    return f"""
    WITH o AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS uid, doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY uid), first_value(text) OVER (ORDER BY uid)) AS next_text, uid % (SELECT count(*) FROM o) + 1 AS next_uid FROM o),
    d AS (SELECT *, length(text)::BIGINT AS n_chars,
                 left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM n),
    a AS {found("text")},
    b AS {found("edited")}
    SELECT d.doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(a.found, '') AS fingerprint, array_to_string(b.found, '') AS edited_fingerprint,
           {likeness("a.found", "b.found")} AS near_edited, {likeness("a.found", "nx.found")} AS near_next
    FROM d JOIN a ON a.uid = d.uid JOIN b ON b.uid = d.uid JOIN a nx ON nx.uid = d.next_uid"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_chat_formatting": op2_chat_formatting,
    "op4_vector_topk": op4_vector_topk,
    "op3_pattern_packing": op3_pattern_packing,
    "op5_token_shards": op5_token_shards,
    "op6_token_counts": op6_token_counts,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spot_signatures": op13_spot_signatures,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": _mix_sql(mixing.PRODUCTION),
    "op2_chat_formatting": _chat_sql(),
    "op4_vector_topk": _TOPK_SQL,
    "op9_quality_rules": _quality_sql(),
    "op12_prefix_trie": _TRIE_SQL,
    "op13_spot_signatures": _spot_sql(),
}
