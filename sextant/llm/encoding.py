"""Whole texts through the tokenizers library, sharing repeated pieces.

The library splits a text into pieces before it merges, and a piece's ids do
not depend on its neighbours.  ``TextEncoder`` cuts texts only where the library
always cuts too, hands each distinct piece to the library once, and joins the
ids.  A text that holds one of the tokenizer's added tokens or unusual white
space, and every text of a tokenizer whose cuts are not known here, goes to the
library as a whole.

Cutting, numbering the distinct pieces of a batch and joining their ids are
array operations; Python sees each distinct piece of a batch once.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered per process: two generations of at most this many.
CACHED = 220_000
SLICE_BYTES = 8 << 20
#: Unicode's White_Space outside ASCII.
_WIDE = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Marks a piece that has no space before it.
GLUED = "\x01"
#: White space whose pieces depend on what stands beside it, and GLUED.
_ODD_SPACED = f"  | \n|\n |\n\n|^[ \n]|[ \n]$|[\t\x0b\x0c\r{GLUED}{_WIDE}]"
#: Letters, then punctuation: every tokenizer known here cuts between the two.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_TAIL = f"([{_LETTERS}])([.,!?;:%&#$*|]+)( |$)"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable
    bytes stand for themselves, the others for the letters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class TextEncoder:
    def __init__(self, path: str, cached: int = CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        #: The same model, held once, without the steps before it, for runs of letters.
        self.model = Tokenizer(self.tokenizer.model)
        self.letters = byte_letters()
        self.cached = cached
        self.now: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        first, normal = config.get("pre_tokenizer") or {}, config.get("normalizer")
        steps = first.get("pretokenizers", [])
        drops = len(steps) == 2 and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "[^\\s\\p{L}\\p{N}]+" in str(steps[0].get("pattern", {}).get("Regex"))
        #: Whether a word's piece holds the space before it, or white space is dropped and case too.
        self.spaced = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not normal
        self.dropped = bool(drops and steps[1].get("type") == "ByteLevel" and [x.get("type") for x in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"])
        odd = [re.escape(x["content"]) for x in config.get("added_tokens", []) if x["content"]]
        self.odd = "|".join([*odd, _ODD_SPACED] if self.spaced else odd)

    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the bounds of each: text k has
        ids[bounds[k] : bounds[k + 1]].  Nulls are empty.  Long batches are
        encoded in slices of about SLICE_BYTES."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        if len(cuts) == 2:
            return self._encode(texts)
        done = [self._encode(texts.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        base = np.cumsum([0] + [len(ids) for ids, _ in done])
        bounds = [b[:-1] + o for (_, b), o in zip(done, base[:-1], strict=True)]
        return np.concatenate([ids for ids, _ in done]), np.append(np.concatenate(bounds), base[-1])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not (self.spaced or self.dropped):
            whole = np.ones(len(texts), bool)
        elif self.odd:
            whole = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        else:
            whole = np.zeros(len(texts), bool)
        if self.spaced:
            marked = pc.replace_substring(texts, "\n", f" {GLUED}\n {GLUED}")
            marked = pc.binary_join_element_wise(pa.scalar(GLUED, pa.large_string()), marked, pa.scalar("", pa.large_string()))
            marked = pc.replace_substring_regex(marked, _TAIL, f"\\1 {GLUED}\\2\\3")
        else:
            marked = pc.replace_substring(texts, "\n", " ")
            wide = pc.match_substring_regex(marked, "[^\\x00-\xff]")  # other letters keep the library's own rules of case
            marked = pc.if_else(wide, marked, pc.utf8_lower(marked))
            marked = pc.replace_substring_regex(marked, _TAIL, "\\1 \\2\\3")
        marked = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), marked)
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        ids = self._pieces(coded.dictionary.to_pylist())
        first = lists.offsets.to_numpy().astype(np.int64)
        if whole.any():  # each is one piece that only this batch knows
            at = np.flatnonzero(whole)
            base = len(ids)
            ids += self._library(texts.take(pa.array(at)).to_pylist())
            index = index.astype(np.int64)
            index[first[at]] = base + np.arange(len(at))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), "<u4")
        length = size[index]
        ends = np.concatenate([[0], np.cumsum(length)])
        shift = (start[index] - ends[:-1]).astype(np.int32 if ends[-1] < 1 << 31 else np.int64)
        where = np.repeat(shift, length)
        where += np.arange(ends[-1], dtype=where.dtype)
        return flat.take(where), ends[first]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.now) > self.cached:
            self.before, self.now = self.now, {"": b""}
        now = self.now
        out = list(map(now.get, pieces))
        unknown = [k for k, ids in enumerate(out) if ids is None]
        missing = [pieces[k] for k in unknown]
        if self.before:
            known = list(map(self.before.get, missing))
            now.update((p, ids) for p, ids in zip(missing, known, strict=True) if ids is not None)
            missing = [p for p, ids in zip(missing, known, strict=True) if ids is None]
        self._learn(missing)
        for k in unknown:
            out[k] = now[pieces[k]]
        return out

    def _learn(self, unknown: list[str]) -> None:
        """Ids of pieces never seen: runs of letters from the bare model, others
        from the whole tokenizer."""
        match, plain = re.compile(f"{GLUED}?[{_LETTERS}]+" if self.spaced else f"[{_LETTERS}]+").fullmatch, self._plain
        letters = [p for p in unknown if match(p)]
        others = [p for p in unknown if not match(p)]
        table = self.letters
        written = [plain(p.lower() if self.dropped else p).encode().decode("latin-1").translate(table) for p in letters]
        self.now.update(zip(letters, self._library(written, self.model), strict=True))
        self.now.update(zip(others, self._library([plain(p) for p in others]), strict=True))

    def _plain(self, piece: str) -> str:
        """A piece as it stands in its text."""
        if not self.spaced:
            return piece
        return piece[1:] if piece[0] == GLUED else " " + piece

    def _library(self, pieces: list[str], tokenizer=None) -> list[bytes]:
        out = []
        for e in (tokenizer or self.tokenizer).encode_batch_fast(pieces, add_special_tokens=False):
            ids = array("I", e.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            out.append(ids.tobytes())
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, cached: int = CACHED) -> TextEncoder:
    """The encoder of one process for one tokenizer file."""
    return TextEncoder(path, cached)
