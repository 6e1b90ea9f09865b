"""Lines that many documents share, found in one range sort of their hashes.

Rows (hash, document, position) are range-partitioned and sorted by all of these, so that a frequent line is
spread over as many partitions as it needs. Each partition streams its runs of a hash: a document's first
occurrence counts once. Runs at a partition's ends may go on in the next; their counts, two rows a partition at
most, are added up afterwards. What comes back is a compressed bitmap a document, not text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, load, small_batches, trim

LEAST_DOCS, LEAST_CHARS = 10, 1
KEY = ["h1", "h2", "doc", "text_key", "pos"]
LINES = "h1 long, h2 long, doc long, text_key long, pos int"
#: What a partition of the sort returns: lines to drop, lines of an end's run that it can't decide, and the ends' runs.
DROP, OPEN, END = 0, 1, 2
FOUND = f"kind int, {LINES}, n long, last_doc long, last_key long"


def line_keys(text: bytes) -> list[bytes]:
    """ASCII letters lower-cased and [\\x20\\x09-\\x0D] stripped, which is what these methods do to bytes."""
    return [line.strip() for line in text.lower().split(b"\n")]


def with_document_key(docs: DataFrame) -> DataFrame:
    """Adds the columns that tell documents apart: rows alike in id and text are one document, a null id none else's."""
    return docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__key": F.xxhash64(F.col("doc_id").isNull(), F.col("text").cast("string"))})


def _explode(least: int):
    def run(batches):
        seen = set()  # documents of this task: those alike come once
        for b in batches:
            docs, keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary())
            ids, at, digests = [], [], []
            for i, own in enumerate(zip(docs, keys, strict=True)):
                if own in seen:
                    continue
                seen.add(own)
                for pos, key in enumerate(line_keys(texts[i].as_py() or b"")):
                    if key and (least <= 1 or len(key.decode()) >= least):
                        ids.append(i)
                        at.append(pos)
                        digests.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            ids = pa.array(ids, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(ids), b.column(1).take(ids), pa.array(at, pa.int32())], names=KEY)
            trim()

    return run


def _stream(least: int):
    """Sorted lines of one partition to the rows of FOUND."""

    def rows(kind: int, x: list[np.ndarray]) -> pa.RecordBatch:
        n = len(x[0])
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(pa.array, x), none, none, none], names=["kind", *KEY, "n", "last_doc", "last_key"])

    def end(run: dict) -> pa.RecordBatch:
        row = [END, *run["hash"], *run["first"], run["n"], *run["last"]]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i in (0, 5) else pa.int64()) for i, v in enumerate(row)], names=["kind", *KEY, "n", "last_doc", "last_key"])

    def run(batches):
        held, now, first = None, None, True  # lines of the open run while its documents are few; the run; whether it's the partition's first
        for b in batches:
            if not len(b):
                continue
            x = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            new_hash = np.concatenate([[now is None or (x[0][0], x[1][0]) != now["hash"]], (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])])
            before = now["last"] if now else (None, None)
            new_doc = new_hash | np.concatenate([[(x[2][0], x[3][0]) != before], (x[2][1:] != x[2][:-1]) | (x[3][1:] != x[3][:-1])])
            starts = np.unique(np.concatenate([[0], np.flatnonzero(new_hash)]))
            stops = np.concatenate([starts[1:], [len(b)]])
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            inner = np.zeros(len(b), bool)  # of runs that lie within this batch and the partition
            for k in sorted({0, len(starts) - 1}):  # the open run and the one that stays open
                s, e = int(starts[k]), int(stops[k])
                if new_hash[s]:
                    if now is not None:
                        yield from close(now, held, first, False)
                        first = False
                    now, held = {"hash": (x[0][s], x[1][s]), "first": (x[2][s], x[3][s], x[4][s]), "n": 0}, None
                now["n"] += int(docs[k])
                now["last"] = (x[2][e - 1], x[3][e - 1])
                own = [c[s:e] for c in x]
                held = own if held is None else [np.concatenate(p) for p in zip(held, own, strict=True)]
                if now["n"] >= least:  # certain, however the run goes on
                    yield rows(DROP, held)
                    held = None
                if k == 0 and len(starts) > 1:
                    yield from close(now, held, first, False)
                    first, now, held = False, None, None
            for k in np.flatnonzero(docs[1:-1] >= least) + 1:
                inner[starts[k] : stops[k]] = True
            if inner.any():
                yield rows(DROP, [c[inner] for c in x])
        if now is not None:
            yield from close(now, held, first, True)
        trim()

    def close(now: dict, held, first: bool, last: bool):
        if first or last:
            yield end(now)
            if held is not None:
                yield rows(OPEN, held)

    return run


def _bitmaps(batches):
    for b in batches:
        keep = []
        for at in b.column(2):
            pos = at.values.to_numpy()
            bits = np.ones((int(pos.max()) | 7) + 1, np.uint8)  # whole bytes, so that none of their bits drops a line
            bits[pos] = 0
            keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.binary())], names=["doc", "text_key", "keep"])


def keep_bitmaps(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """(doc, text_key, keep) of the documents that lose lines: zlib-compressed bits, 0 for a line that goes; lines after the last bit stay."""
    spark = small_batches(docs.sparkSession)
    scratch = scratch or Scratch(spark)
    lines = with_document_key(docs.select("doc_id", "text")).select("__doc", "__key", F.col("text").cast("string")).mapInArrow(_explode(least_chars), LINES)
    lines = scratch.save(lines, "lines")  # the sort reads them twice: for its bounds, then to deal them out
    found = scratch.save(lines.repartitionByRange(*KEY).sortWithinPartitions(*KEY).mapInArrow(_stream(least_docs), FOUND), "runs")
    scratch.drop("lines")
    order = Window.partitionBy("h1", "h2").orderBy("doc", "text_key", "pos")
    again = F.struct("doc", "text_key") == F.lag(F.struct("last_doc", "last_key")).over(order)  # a document across two partitions
    ends = found.where(F.col("kind") == END).withColumn("n", F.col("n") - F.coalesce(again.cast("int"), F.lit(0)))
    frequent = ends.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("h1", "h2")
    late = found.where(F.col("kind") == OPEN).join(F.broadcast(frequent), ["h1", "h2"], "left_semi")  # two rows a partition at most
    gone = found.where(F.col("kind") == DROP).select("doc", "text_key", "pos").unionByName(late.select("doc", "text_key", "pos"))
    per = gone.groupBy("doc", "text_key").agg(F.collect_set("pos").alias("at"))  # the lines of one document
    return per.mapInArrow(_bitmaps, "doc long, text_key long, keep binary")


def _kept(batches):
    for b in batches:
        texts, out, size, lost = b.column(1).cast(pa.large_binary()), [], [], []
        for i, keep in enumerate(b.column(2)):
            lines = (texts[i].as_py() or b"").split(b"\n")
            size.append(len(lines))
            if keep.is_valid:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), bitorder="little")
                gone = set(np.flatnonzero(bits[: len(lines)] == 0).tolist())
                lines = [x for k, x in enumerate(lines) if k not in gone]
                lost.append(len(gone))
            else:
                lost.append(0)
            out.append(b"\n".join(lines).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])
        trim()


def line_dedup(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row of ``docs`` (doc_id, text): without the lines whose key ``least_docs``
    documents or more have; a line's key is it lower-cased (A-Z) and stripped, and counts from ``least_chars`` code points on.

    A null or empty text is one empty line. Rows alike in id and text are one document for the count, and each is returned;
    rows that share an id, or have none, but differ in text are documents of their own. Lines and texts may be of any
    length. An empty table gives no rows; other columns are not read. Texts meet their bitmaps in one join by document.
    """
    keep = keep_bitmaps(docs, least_docs, least_chars).withColumnsRenamed({"doc": "__doc", "text_key": "__key"})
    rows = with_document_key(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).join(keep, ["__doc", "__key"], "left")
    return rows.select("doc_id", "text", "keep").mapInArrow(_kept, "doc_id long, n_lines long, n_dropped long, text string")


def op13_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT doc_id, t, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM (SELECT DISTINCT doc_id, t, key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
g AS (SELECT doc_id, t, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM f)), '') AS kept, count(*) FILTER (key IN (SELECT key FROM f)) AS n_dropped FROM k GROUP BY doc_id, t)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.t = g.t
"""
