"""Language identification by compression.

A text is encoded by zstandard once per language, each time primed with a raw
dictionary of that language's text; the shortest encoding names the language.
The dictionaries come from a bounded, seeded sample of the labelled rows of every
label.  Prediction is one map-only pass over whole texts.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.common import slices

#: Predicted for a null text and one without letters.
UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    """dict_bytes: size of a language's dictionary.  sample_docs, sample_chars:
    the most labelled rows of a language, and characters of each, that training
    reads.  piece_chars: a text is encoded in pieces of this length, so that the
    dictionary and not the text's own start decides.  level: zstandard's.
    min_margin: a best encoding shorter than the second by a smaller fraction is
    rejected as undecided.  repeat_to: a shorter text is repeated up to this length,
    since zstandard stores very short inputs as they are; the repetitions cost the
    same in every language."""

    dict_bytes: int = 131_072
    sample_docs: int = 200
    sample_chars: int = 2_000
    piece_chars: int = 4_096
    level: int = 6
    min_margin: float = 0.005
    repeat_to: int = 256
    seed: str = "langid-1"


_NOT_WORDS = re.compile(r"[\W\d_]+")


@functools.cache
def _numbers() -> frozenset[str]:
    """Characters that \\w takes in beside letters (Unicode's L) and digits, such as halves and numerals."""
    return frozenset(c for c in map(chr, range(128, sys.maxunicode)) if c.isnumeric() and unicodedata.category(c)[0] != "L")


def normalise(text: str | None) -> str:
    """Lower case, with every run of other characters than letters as one space."""
    clean = _NOT_WORDS.sub(" ", (text or "").lower())
    if not clean.isascii() and not _numbers().isdisjoint(clean):
        clean = " ".join("".join(" " if c in _numbers() else c for c in clean).split())
    return clean.strip()


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce((F.crc32(id_col.cast("string").cast("binary")) % 4) == 2, F.lit(False))


def train(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A raw dictionary per language from rows that are labelled and not held out.

    Rows are drawn in the order of a seeded hash of id and text: a first pass over
    (label, hash) finds up to which hash a language's first sample_docs rows reach,
    a second takes these rows, each cut to sample_chars, to the driver: languages x
    200 x 2,000 characters.  Rows that repeat have one hash; a window holds the bound
    all the same.  Null and empty texts teach nothing.
    """
    rows = docs.select(F.col(id_col).alias("l_id"), F.col(text_col).alias("l_text"), F.col(lang_col).alias("l_lang"))
    rows = rows.filter(F.col("l_lang").isNotNull() & F.col("l_text").isNotNull() & ~held_out(F.col("l_id")))
    rows = rows.withColumn("l_draw", F.xxhash64(F.col("l_id").cast("string"), F.col("l_text"), F.lit(params.seed)))
    first = Window.partitionBy("l_lang").orderBy("l_draw")
    narrow = rows.select("l_lang", "l_draw").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= params.sample_docs)
    reach = {r[0]: r[1] for r in narrow.groupBy("l_lang").agg(F.max("l_draw")).collect()}
    if not reach:
        return {}
    drawn = rows.filter(F.col("l_draw") <= F.create_map(*[F.lit(x) for pair in reach.items() for x in pair])[F.col("l_lang")])
    drawn = drawn.select("l_lang", "l_draw", F.substring("l_text", 1, params.sample_chars).alias("t"))
    place = F.row_number().over(Window.partitionBy("l_lang").orderBy("l_draw", "t"))
    sample: dict[str, list[str]] = {}
    for lang, _, text, _ in sorted(map(tuple, drawn.withColumn("place", place).filter(F.col("place") <= params.sample_docs).collect())):
        sample.setdefault(lang, []).append(text)
    out = {}
    for lang, texts in sample.items():
        raw = " ".join(filter(None, map(normalise, texts))).encode()
        if raw:
            out[lang] = raw[: params.dict_bytes]
    return out


@functools.lru_cache(maxsize=2)
def _coders(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list:
    """Compressors of one process, made once."""
    import zstandard as zstd

    coders = []
    for _, raw in dictionaries:
        primed = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        coders.append(zstd.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False))
    return coders


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], params: Params) -> tuple[str, float, float]:
    """Language, score and margin of one text.

    score: share of the best language if a language weighs 2 to the power of
    minus its encoding's bits; 0 if undetermined.  margin: how much shorter the
    best encoding is than the second, as a fraction (1 with one language).
    Ties go to the language first in alphabetical order.
    """
    clean = normalise(text)
    if not clean or not dictionaries:
        return UNDETERMINED, 0.0, 0.0
    sizes = [0] * len(dictionaries)
    if len(clean) < params.repeat_to:
        clean = " ".join([clean] * (1 + params.repeat_to // (1 + len(clean))))
    for at in range(0, len(clean), params.piece_chars):
        piece = clean[at : at + params.piece_chars].encode("utf-8", "replace")
        for k, coder in enumerate(_coders(dictionaries, params.level)):
            sizes[k] += len(coder.compress(piece))
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    best = sizes[order[0]]
    score = 1.0 / sum(2.0 ** max(-1000.0, 8.0 * (best - s)) for s in sizes)
    margin = (sizes[order[1]] - best) / sizes[order[1]] if len(sizes) > 1 else 1.0
    return dictionaries[order[0]][0], score, margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], params: Params = Params(), text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in carry, then ``lang_pred``, ``score``, ``margin``, ``rejected``.

    Null texts, and texts without a letter, get ``und``, score 0 and are
    rejected.  One row per input row, repeated rows included.
    """
    table = tuple(sorted(dictionaries.items()))
    rows = docs.select(F.col(text_col).alias("t"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
    carried = rows.schema.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [classify(t, table, params) for t in batch.column(0).to_pylist()]
            new = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*[f.name for f in carried], "lang_pred", "score", "margin"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried)
    out = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, margin double")
    rejected = (F.col("lang_pred") == UNDETERMINED) | (F.col("margin") < params.min_margin)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], "lang_pred", "score", "margin", rejected.alias("rejected"))


def is_held_out(doc_id: object) -> bool:
    """``held_out`` outside Spark."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
