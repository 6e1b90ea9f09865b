"""Packing token sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows; what remains is placed, longest piece
first, into the open window with the least remaining capacity that holds it. A segment tree over
remaining capacities finds that window. Pieces are dealt into independent groups of bounded size.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, small_batches, trim

WINDOW, END = 4096, 2
#: Tokens of a group: about 4,000 windows, packed by one task in bounded memory.
GROUP_TOKENS = 16_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"
_SPACED: dict[str, "SpacedEncoder"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Coded(dict):
    """Ids of words, as little-endian 32-bit bytes. Words that it lacks are coded as they are asked for."""

    def __init__(self, code, older: dict):
        super().__init__()
        self.code, self.older = code, older

    def __missing__(self, word: bytes) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.code(word)
        if len(word) <= SpacedEncoder.LONG:
            self[word] = got
        return got


class SpacedEncoder:
    """Ids of a lower-casing tokenizer with word ends, as little-endian 32-bit bytes; ids of words seen of late are held.

    Such a tokenizer cuts a text at white space and between letters, digits and signs, and codes each
    part alone, so a text's ids are its parts' ids in a row. Words of ASCII and Latin-1 letters are cut
    here (PART is the tokenizer's own rule on them) and their parts go to its model; other words go to it
    whole, as do the texts of a tokenizer with another rule.
    """

    HELD, LONG = 300_000, 48
    RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    STEPS = ["NFC", "Replace", "Lowercase"]
    PART = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[^\sa-z0-9\x80-\xff]+")
    OTHER = re.compile(rb"[\xc2\xc4-\xff]|\xc3[\x97\xb7]|<\|")
    PACK = [struct.Struct(f"<{n}I").pack for n in range(LONG + 1)]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        how = json.loads(self.tokenizer.to_str())
        cuts = (how["pre_tokenizer"] or {}).get("pretokenizers", [])
        steps = [x["type"] for x in (how["normalizer"] or {}).get("normalizers", [])]
        self.spaced = steps == self.STEPS and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": self.RULE} and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"]
        self.model, self.letters, self.words = self.tokenizer.model, byte_letters(), Coded(self.code, {})

    def code(self, word: bytes) -> bytes:
        if word.isalpha():  # of bytes, so ASCII letters alone
            return self.part(word)
        parts = self.PART.findall(word)
        return self.part(word) if len(parts) == 1 else b"".join(map(self.known, parts))

    def known(self, part: bytes) -> bytes:
        """Of a part of a word, which may be a word itself."""
        got = self.words.get(part) or self.words.older.get(part)
        if got is None:
            got = self.part(part)
            if len(part) <= self.LONG:
                self.words[part] = got
        return got

    def part(self, part: bytes) -> bytes:
        if part.isalpha():
            letters = part.decode()
        else:
            letters = (part if part.isascii() else part.decode().lower().encode()).decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.model.tokenize(letters)])

    def packed(self, ids: list[int]) -> bytes:
        return self.PACK[n](*ids) if (n := len(ids)) <= self.LONG else np.array(ids, "<u4").tobytes()

    def mixed(self, text: bytes) -> bytes:
        """Of a text with other signs: words that hold one go to the tokenizer, each of them once."""
        own, get = {}, self.words.__getitem__
        for word in set(text.split()):
            odd = self.OTHER.search(word)
            own[word] = self.packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids) if odd else get(word.lower())
        return b"".join(map(own.__getitem__, text.split()))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Texts of bounded size together."""
        if not self.spaced:
            got = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(x.ids, "<u4").tobytes() for x in got]
        if len(self.words) > self.HELD:
            self.words = Coded(self.code, dict(self.words))
        get = self.words.__getitem__
        odd = self.OTHER.search
        return [self.mixed(t) if not t.isascii() and odd(t) or b"<|" in t else b"".join(map(get, t.lower().split())) for t in texts]


def encoder(path: str) -> SpacedEncoder:
    if path not in _SPACED:
        _SPACED[path] = SpacedEncoder(path)
    return _SPACED[path]


def pieces_of(name: str, window: int = WINDOW, end: int = END):
    """A mapInArrow function: (doc_id, text) to pieces; ids_crc32 is of the piece's ids."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        coder = encoder(name if os.sep in name else tokenizer_path(name))
        for b in batches:
            ids, rows, texts, held, size = b.column(0).to_pylist(), [], [], [], 0
            column = b.column(1)
            for i in range(len(b)):
                texts.append((column[i].as_py() or "").encode())
                held.append(ids[i])
                size += len(texts[-1])
                if size < 2_000_000 and i + 1 < len(b):
                    continue
                for doc, coded in zip(held, coder.encode(texts), strict=True):
                    view = memoryview(coded + tail)
                    n = len(view) // 4
                    for s in range(0, n, window):
                        e = min(n, s + window)
                        rows.append((doc, s, e - s, zlib.crc32(view[4 * s : 4 * e]), n))
                texts, held, size = [], [], 0
            trim()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class Open:
    """Open windows by remaining capacity: a segment tree over 0..window whose nodes tell if a leaf below holds any."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, left: int, window: int) -> None:
        if not self.bins[left]:
            k = left + self.leaves
            while k and not self.tree[k]:
                self.tree[k] = 1
                k >>= 1
        self.bins[left].append(window)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out (remaining, window) of the least remaining capacity that is ``need`` or more."""
        tree, k = self.tree, need + self.leaves
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        left = k - self.leaves
        window = self.bins[left].pop()
        if not self.bins[left]:
            tree[k] = 0
            k >>= 1
            while k and not tree[2 * k] and not tree[2 * k + 1]:
                tree[k] = 0
                k >>= 1
        return left, window


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows and offsets of pieces that are sorted by falling length."""
    at, offset, used, tree = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, Open(window)
    for i, n in enumerate(lengths.tolist()):
        if found := tree.tightest(n) if n < window else None:
            left, k = found
        else:
            left, k = window, used
            used += 1
        at[i], offset[i] = k, window - left
        if left > n:
            tree.add(left - n, k)
    return at, offset


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "piece"], ascending=[False, True], ignore_index=True)
    at, offset = best_fit(pdf["length"].to_numpy())
    pdf["sequence_id"], pdf["offset"] = at + (pdf["dealt"].to_numpy() << 32), offset
    return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text) and their places in windows of 4096 ids.

    A null or empty text is the end id alone. Rows that share or lack an id are packed each for
    itself; a very long text is cut into as many pieces as it needs; an empty table gives no rows; other columns are not read. Each piece's row is written to
    the shared scratch folder with its number, so that a lost executor deals the same groups again.
    """
    scratch = Scratch(small_batches(spark))
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces_of(tokenizer), PIECES)
    rows = scratch.save(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    total = rows.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / GROUP_TOKENS))
    return rows.withColumn("dealt", F.pmod(F.xxhash64("piece"), F.lit(groups))).groupBy("dealt").applyInPandas(_pack, PACKED)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, load(spark, sf_dir, "documents"))
