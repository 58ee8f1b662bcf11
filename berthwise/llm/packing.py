"""Packing by power-of-two decomposition.

A document's ids (its tokens and one end id) are cut into pieces of binary
lengths: as many full sequences as fit, then one piece for each set bit of the
rest, longest first.  Pieces of one length form a bucket, and each piece is a sequence of its
own: no sequence crosses documents and none is padded, because all lengths are
powers of two.  One Arrow pass, no shuffle.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
as often as they occur; a null ``doc_id`` stays null; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 2048
END_ID = 1
CACHED_WORDS = 350_000
TOGETHER = 32                    # longer texts cost the library more per word
# Words that normalisation only makes lower case: ASCII and Latin letters and signs, no white space or controls.
_PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u0148\u014a-\u017e]+").fullmatch
# Byte-level text: printable bytes stand for themselves, the others for the code points from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_TEXT = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordTokenizer:
    """Ids of whole texts, for tokenizers whose tokens never cross white space and that
    treat all white space alike: each distinct word goes through the library
    once and its ids are remembered.

    Two generations of remembered words bound the memory; words in use move to
    the young one.  ``crosses_space`` says when the shortcut doesn't hold, and then whole
    texts go through the library."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        import json

        from tokenizers import Tokenizer
        spec = json.load(open(path, encoding="utf-8"))
        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.cached = cached
        self.by_word = not self.crosses_space(spec)
        self.special = [t["content"].lower() for t in spec.get("added_tokens", [])]
        self.split = self.part_pattern(spec)

    @staticmethod
    def part_pattern(spec: dict):
        """The tokenizer's own split pattern, if its parts go to the model as lower-case byte text and nothing else."""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        norm = [n["type"] for n in steps]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if norm != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": r"\s+"} or steps[1]["content"].strip() or [p["type"] for p in pre] != ["Split", "ByteLevel"] \
                or pre[1].get("add_prefix_space") or pre[1].get("use_regex") or spec["model"]["type"] != "BPE":
            return None
        return regex.compile(pre[0]["pattern"]["Regex"])

    @staticmethod
    def crosses_space(spec: dict) -> bool:
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [pre])
        splits = [p for p in parts if p.get("type") == "Split"]
        drops = any(p.get("behavior") == "Removed" and p.get("invert") and r"[^\s" in p["pattern"].get("Regex", "") for p in splits)
        glued = any(any(ch.isspace() for ch in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]
                    for t in spec.get("added_tokens", []))
        return not drops or glued

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words.  Those of plain Latin letters and signs, which normalisation only makes lower
        case, share the ids of their parts; the others go through the library."""
        if self.split is None:
            return self._encode(words)
        rest = []
        find, parts, young = self.split.findall, self.parts, self.young
        for w in words:
            if w.isalpha():                             # ASCII letters: one part
                found = (w.lower().decode(),)
            elif w[:-1].isalpha() and 32 < w[-1] < 127:  # and one more for a sign or digit behind them
                found = (w[:-1].lower().decode(), chr(w[-1]))
            else:
                text = w.decode("utf-8").lower()
                if not _PLAIN(text) or ("<" in text and any(t in text for t in self.special)):
                    rest.append(w)
                    continue
                found = find(text)
            try:
                young[w] = b"".join([parts[p] for p in found])
            except KeyError:
                for p in found:
                    if p not in parts:
                        shown = p if p.isascii() else p.encode("utf-8").decode("latin-1").translate(_BYTE_TEXT)
                        ids = [t.id for t in self.model.tokenize(shown)]
                        parts[p] = struct.pack(f"<{len(ids)}I", *ids)
                young[w] = b"".join([parts[p] for p in found])
        if len(parts) > 3 * self.cached // 2:
            parts.clear()
        if rest:
            self._encode(rest)

    def _encode(self, words: list[bytes]) -> None:
        """Words through the library, ``TOGETHER`` to a text; token offsets tell whose they are."""
        texts = [w.decode("utf-8") for w in words]
        cuts = range(0, len(words), TOGETHER)
        for lo, enc in zip(cuts, self.lib.encode_batch([" ".join(texts[i:i + TOGETHER]) for i in cuts], add_special_tokens=False)):
            raw = np.array(enc.ids, dtype="<u4").tobytes()
            starts = [o[0] for o in enc.offsets]
            at = end = 0
            for w, t in zip(words[lo:lo + TOGETHER], texts[lo:lo + TOGETHER]):
                end += len(t) + 1
                first = at
                while at < len(starts) and starts[at] < end:
                    at += 1
                self.young[w] = raw[4 * first:4 * at]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.lib.encode_batch(texts, add_special_tokens=False)]
        split = [t.encode("utf-8").split() for t in texts]
        distinct = set()
        for words in split:
            distinct.update(words)
        new = distinct.difference(self.young)
        seen = self.old.keys() & new
        for w in seen:
            self.young[w] = self.old[w]
        self._learn(list(new.difference(seen)))
        of = self.young.__getitem__
        out = [b"".join(map(of, words)) for words in split]
        if len(self.young) > self.cached:
            self.old, self.young = self.young, {}
        return out


_IN_WORKER: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer_of(path: str, cached: int) -> WordTokenizer:
    """The worker process's tokenizer; later tasks find the words of earlier ones.  One is held at a time."""
    if (path, cached) not in _IN_WORKER:
        _IN_WORKER.clear()
        _IN_WORKER[path, cached] = WordTokenizer(path, cached)
    return _IN_WORKER[path, cached]


def binary_lengths(total: int, sequence: int = SEQUENCE) -> list[int]:
    """Piece lengths of a document: full sequences, then the set bits of the rest."""
    full, rest = divmod(total, sequence)
    return [sequence] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def packed(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, cached: int = CACHED_WORDS) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset) of every piece; ids are little-endian
    unsigned 32-bit.  A worker process remembers up to twice ``cached`` words, about 0.25 KB each, until it ends.

    A sequence's number has its bucket on top, then the task that made it, then its place in the task:
    buckets lie together, numbers are never shared, and nothing is counted or moved for them."""
    if sequence & (sequence - 1):
        raise ValueError("the sequence length must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()
    top = sequence.bit_length()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer_of(tokenizer, cached)
        task = TaskContext.get().partitionId()
        made = [0] * (top + 1)
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo:lo + 256]
                rows = []
                for doc_id, ids in zip(part["doc_id"], tok.ids([t or "" for t in part["text"]])):
                    ids += end
                    start, n = 0, len(ids) // 4
                    for length in binary_lengths(n, sequence):
                        bucket = top - length.bit_length()
                        rows.append((doc_id, start, length, n, ids[4 * start:4 * (start + length)],
                                     bucket << 57 | task << 33 | made[bucket], 0))
                        made[bucket] += 1
                        start += length
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])
    # Ids pass as text, so that nulls beside them don't make them floats.
    src = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = src.mapInPandas(run, "doc_id string, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def digest(p: DataFrame) -> DataFrame:
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
