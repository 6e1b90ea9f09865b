"""Stupid-backoff scores from n-gram count tables partitioned by hash.

Each document is scored by the rest of the corpus: of every n-gram's count the document's own is taken
off, so that no text vouches for itself. Documents are dealt into chunks of bounded size. The rows
(chunk, n-gram, count) of a chunk travel to the count tables sorted and packed, as columns: a block for
each hash partition. There counts are added up by n-gram; the totals come back to each block in its order,
which joins them to the chunk's exploded n-grams, and a document's log scores are summed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, mix64, small_batches, trim

ORDER, BACKOFF = 3, 0.4
#: Bytes of a chunk, whose n-grams one task holds at a time (a longer text is a chunk of its own or with a few
#: others), and of text for each hash partition; bytes and rows that travel together to a chunk; tasks at most.
CHUNK, PART = 12_000_000, 16_000_000
BLOCK, ROWS, TASKS = 1_000_000, 20_000, 20_000
_COEF = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each white-space separated word of the texts, letters A-Z folded, and the word's text."""
    raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    inner = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(inner.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start = np.flatnonzero(edge == 1)
    length = np.flatnonzero(edge == -1) - start
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    coef = _COEF if length.max() <= len(_COEF) else mix64(np.arange(1, length.max() + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value = (raw[inner].astype(np.uint64) + np.uint64(1)) * coef[np.arange(len(first) and first[-1] + length[-1]) - np.repeat(first, length)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mix64(np.add.reduceat(value, first) + length.astype(np.uint64)), np.searchsorted(ends, start, "right")


def ngrams(words: np.ndarray, of: np.ndarray, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to ``order`` the hashes of the n-grams inside texts, and the places of their last words."""
    out, h = [(words, np.arange(len(words)))], words
    for n in range(2, order + 1):
        h = mix64(h[: len(h) - 1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :] + np.uint64(n)) if len(h) > 1 else h[:0]
        inside = of[: len(h)] == of[n - 1 :][: len(h)]
        out.append((h[inside], np.flatnonzero(inside) + n - 1))
    return out


def blocks(texts: list[bytes], size: int = 1_000_000):
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


_ZSTD, _PACK = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1, write_content_size=True)


def zstd(raw: bytes) -> bytes:
    return _PACK.compress(raw)


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte planes apart."""
    d = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstd(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(block: bytes) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(block), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    return zstd(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def counts_of(block: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_ZSTD.decompress(block), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def chunk_ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of a chunk and their counts."""
    grams = [g for some in blocks(texts) for g, _ in ngrams(*word_hashes(some))]
    every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    del grams
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.diff(first, append=len(every))


def _dealt(chunks: int):
    """(doc_id, text) to blocks of documents, which go around the chunks from a place that depends on the task."""

    def run(batches):
        at, ids, texts, size = int(mix64(np.array([TaskContext.get().partitionId()], np.uint64))[0]) % chunks, [], [], 0

        def block() -> pa.RecordBatch:
            facts = np.array([([i or 0 for i in ids]), [i is None for i in ids], [len(t) for t in texts]], "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zstd(facts)], pa.binary()), pa.array([zstd(b"".join(texts))], pa.binary())], names=["chunk", "facts", "texts"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append((t.as_py() or "").encode())
                size += len(texts[-1])
                if size >= BLOCK or len(ids) >= ROWS:
                    yield block()
                    at, ids, texts, size = (at + 1) % chunks, [], [], 0
        if ids:
            yield block()
        trim()

    return run


def whole(pdf: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """A chunk's documents: their ids and whether they lack one (rows of an array), and their texts. The order of its blocks doesn't matter."""
    facts, texts = [np.zeros((2, 0), np.int64)], []
    for block, raw in zip(pdf["facts"], pdf["texts"], strict=True):
        got, raw = np.frombuffer(_ZSTD.decompress(block), "<i8").reshape(3, -1), _ZSTD.decompress(raw)
        ends = np.cumsum(got[2]).tolist()
        texts += [raw[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
        facts.append(got[:2])
    return np.concatenate(facts, axis=1), texts


def parted(own: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of the parts that sorted hashes fall into: found from the hashes, so however many parts there are."""
    part = (((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint32)
    cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(own)]
    return [(int(part[a]), a, b) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def _emit(parts: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, n = chunk_ngrams(whole(pdf)[1])
        rows = [(key[0], p, packed(own[a:b]), small(n[a:b])) for p, a, b in parted(own, parts)]
        del own, n
        trim()
        return pd.DataFrame(rows, columns=["chunk", "part", "grams", "counts"])

    return run


def _total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Adds up one hash partition's blocks; answers each with the totals of its n-grams, in their order."""
    own = [unpacked(b) for b in pdf["grams"]]
    every = np.unique(np.concatenate(own))
    sums = np.zeros(len(every), np.int64)
    at = []
    for b, n in zip(own, pdf["counts"], strict=True):
        at.append(np.searchsorted(every, b).astype(np.uint32))
        sums[at[-1]] += counts_of(n)
    out = pd.DataFrame({"chunk": pdf["chunk"], "part": pdf["part"], "totals": [small(sums[i]) for i in at]})
    del own, every, sums
    trim()
    return out


def backoff(texts: list[bytes], own: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """By text: its words; of those, the ones scored by a seen and by an unseen unigram; the sum of the logs of
    the rest of the factors. own, totals: the chunk's n-grams and their counts over the corpus."""
    words, of = word_hashes(texts)
    score, seen, longer = np.zeros(len(words)), np.zeros(len(words), bool), np.zeros(len(words), bool)
    before = np.zeros(len(words), np.int64)  # the rest's count of the (n-1)-gram that ends at a word
    for n, (grams, at) in enumerate(ngrams(words, of), 1):
        value, back = np.unique(grams, return_inverse=True)
        pair = back * np.int64(len(texts)) + of[at]
        _, same, count = np.unique(pair, return_inverse=True, return_counts=True)
        rest = totals[np.searchsorted(own, value)][back] - count[same]
        now = np.zeros(len(words), np.int64)
        now[at] = rest
        if n == 1:
            seen = rest > 0
            score = np.log(np.maximum(rest, 1))
        else:
            found = rest > 0
            yes, no = at[found], at[~found]
            score[yes] = np.log(rest[found]) - np.log(before[yes - 1])
            longer[yes] = True
            score[no] += np.log(BACKOFF)
        before = now
    by = lambda w: np.bincount(of, weights=w, minlength=len(texts))
    return np.stack([by(np.ones(len(words))), by(seen & ~longer), by(~seen & ~longer), by(score)])


def _score(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    ids, texts = whole(docs)
    own, _ = chunk_ngrams(texts)
    answers = answers.sort_values("part")
    totals = np.concatenate([counts_of(b) for b in answers["totals"]]) if len(answers) else np.zeros(1, np.int64)
    got = np.concatenate([backoff(some, own, totals) for some in blocks(texts)], axis=1) if len(texts) else np.zeros((4, 0))
    out = pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids[0].copy(), ids[1] > 0), "n_words": got[0].astype(np.int64), "seen": got[1].astype(np.int64), "unseen": got[2].astype(np.int64), "logs": got[3]})
    del own, totals
    trim()
    return out


def lm_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) for each row of ``docs`` (doc_id, text).

    S(w | h) is c(hw) / c(h) where the rest of the corpus has hw, else 0.4 S(w | h without its first
    word); a word that the rest lacks scores 1 / (rest's words + 1). A null or wordless text has no
    words, log_score 0 and a null mean; an empty table gives no rows. Repeated rows are documents of their own, so
    each vouches for the other, and go to different chunks; a very long text is scored whole, by one task; null ids
    stay; other columns are not read.
    """
    scratch = Scratch(small_batches(spark))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    chunks, parts = max(1, -(-size // CHUNK)), max(1, -(-size // PART))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_dealt(chunks), "chunk int, facts binary, texts binary")
    rows = rows.repartitionById(min(chunks, TASKS), F.col("chunk"))  # by number, as hashes would put several in one task
    sent = rows.groupBy("chunk").applyInPandas(_emit(parts), "chunk int, part int, grams binary, counts binary")
    answers = sent.repartitionById(min(parts, TASKS), F.col("part")).groupBy("part").applyInPandas(_total, "chunk int, part int, totals binary")
    answers = answers.repartitionById(min(chunks, TASKS), F.col("chunk"))
    got = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_score, "doc_id long, n_words long, seen long, unseen long, logs double")
    got = scratch.save(got, "scores")  # one job: the texts' shuffle serves both passes
    corpus = got.agg(F.sum("n_words")).first()[0] or 0
    left = F.lit(corpus) - F.col("n_words")
    log_score = F.col("logs") - F.col("seen") * F.log(F.greatest(left, F.lit(1)).cast("double")) - F.col("unseen") * F.log((left + 1).cast("double"))
    mean = F.try_divide(log_score, F.col("n_words").cast("double"))
    return got.select("doc_id", "n_words", F.round(log_score, 6).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark, load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH words AS (
  SELECT d.rowid AS k, d.doc_id, unnest(w) AS w, unnest(range(len(w))) AS i
  FROM (SELECT row_number() OVER () AS rowid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents) d),
toks AS (
  SELECT k, doc_id, i, w, lag(w) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY k ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM toks GROUP BY w),
c2 AS (SELECT w1, w, count(*) AS n FROM toks WHERE w1 IS NOT NULL GROUP BY w1, w),
c3 AS (SELECT w2, w1, w, count(*) AS n FROM toks WHERE w2 IS NOT NULL GROUP BY w2, w1, w),
rest AS (
  SELECT t.k, t.doc_id, t.i,
    a.n - count(*) OVER (PARTITION BY t.k, t.w) AS u,
    CASE WHEN t.w1 IS NULL THEN 0 ELSE b.n - count(*) OVER (PARTITION BY t.k, t.w1, t.w) END AS bi,
    CASE WHEN t.w2 IS NULL THEN 0 ELSE c.n - count(*) OVER (PARTITION BY t.k, t.w2, t.w1, t.w) END AS tri,
    (SELECT count(*) FROM toks) - count(*) OVER (PARTITION BY t.k) AS total
  FROM toks t JOIN c1 a ON t.w = a.w LEFT JOIN c2 b ON t.w1 = b.w1 AND t.w = b.w LEFT JOIN c3 c ON t.w2 = c.w2 AND t.w1 = c.w1 AND t.w = c.w),
before AS (SELECT *, lag(u) OVER o AS u1, lag(bi) OVER o AS b1 FROM rest WINDOW o AS (PARTITION BY k ORDER BY i)),
s1 AS (SELECT *, CASE WHEN u > 0 THEN u::DOUBLE / greatest(total, 1)::DOUBLE ELSE 1::DOUBLE / (total + 1)::DOUBLE END AS p1 FROM before),
s2 AS (SELECT *, CASE WHEN i < 1 THEN p1 WHEN bi > 0 THEN bi::DOUBLE / u1::DOUBLE ELSE 0.4::DOUBLE * p1 END AS p2 FROM s1),
s3 AS (SELECT *, CASE WHEN i < 2 THEN p2 WHEN tri > 0 THEN tri::DOUBLE / b1::DOUBLE ELSE 0.4::DOUBLE * p2 END AS p3 FROM s2),
per AS (SELECT k, doc_id, count(*) AS n, sum(ln(p3)) AS s FROM s3 GROUP BY k, doc_id)
SELECT d.doc_id, coalesce(p.n, 0)::BIGINT AS n_words, round(coalesce(p.s, 0::DOUBLE), 6) AS log_score, round(p.s / p.n::DOUBLE, 6) AS mean_log_score
FROM (SELECT row_number() OVER () AS k, doc_id FROM documents) d LEFT JOIN per p ON d.k = p.k
"""
