"""Secret scans: all rules as one minimal automaton, run over the bytes of many documents in one pass."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Scanner
from .common import load, sha_of, small_batches, trim

BASE = ("assign", "access", "hex")
#: kind: (pattern, letters in either case). Where a length is asked for besides, see ``keeps``.
RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True),
    "access": (r"AKIA[A-Z0-9]+", False),
    "hex": (r"[0-9a-f]{8,}", False),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", False),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", False),
    "google": (r"AIza[A-Za-z0-9_-]+", False),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False),
}
LEAST = {"access": 20, "hex": 24, "github": 40, "slack": 15, "google": 39}
#: What a private key's span takes in behind its first line: headers, the key's lines and the last line, as far as they are
#: there. As part of the rule they would triple the automaton (24,667 states), so the span is extended where the rule has matched.
KEY = re.compile(rb"(?:\r?\n(?:Proc-Type|DEK-Info): [\x20-~]+)*(?:(?:\r?\n)+[A-Za-z0-9+/=]{16,})*(?:(?:\r?\n[A-Za-z0-9+/=]+)?\r?\n-----END [A-Z ]*PRIVATE KEY-----)?")
SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
#: Bytes that are scanned at once.
BLOCK = 2_000_000
_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner(RULES))
    return _SCANNER[0]


def keeps(kind: str, value: bytes) -> bool:
    if kind == "assign":
        rest = value[min(i for i in (value.find(b":"), value.find(b"=")) if i >= 0) + 1 :].lstrip(b" ")
        return len(rest) - (rest[:1] in (b'"', b"'")) >= 6
    return len(value) >= LEAST.get(kind, 0)


def find_all(texts: list[bytes]) -> list[list[tuple[str, int, int, bytes]]]:
    """Spans of each text, in code points, by start, then kind as listed. A byte that no text holds parts the texts."""
    scan, found = scanner(), [[] for _ in texts]
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    points: dict[int, np.ndarray] = {}
    for k, s, e in scan.spans(b"\xff".join(texts)):
        d = int(np.searchsorted(at, s, "right")) - 1
        s, e = s - int(at[d]), e - int(at[d])
        if scan.kinds[k] == "pem":
            e = KEY.match(texts[d], e).end()
        if keeps(kind := scan.kinds[k], value := texts[d][s:e]):
            if d not in points:
                points[d] = np.concatenate([[0], np.cumsum((np.frombuffer(texts[d], np.uint8) & 0xC0) != 0x80)])
            found[d].append((k, int(points[d][s]), int(points[d][e]), value, kind))
    return [[(kind, s, e, v) for k, s, e, v, kind in sorted(own, key=lambda x: (x[1], x[0]))] for own in found]


def in_blocks(column: pa.Array):
    """Lists of texts (null: empty) of bounded size together; a text that is longer stands alone."""
    texts, size = [], 0
    for x in column:
        texts.append((x.as_py() or "").encode())
        size += len(texts[-1])
        if size >= BLOCK:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _scan(batches):
    for b in batches:
        spans = [[dict(kind=k, start=s, end=e, value=v.decode()) for k, s, e, v in own] for texts in in_blocks(b.column(1)) for own in find_all(texts)]
        trim()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _TYPE)], names=["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of ``docs``: kind, start and end in code points (end exclusive), value.

    A null or empty text has no spans; a very long one is scanned whole; repeated rows and ids stay as they are; an
    empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, f"doc_id long, spans {SPAN}")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each span of ``text`` (overlapping ones as one) replaced by ``[SECRET]``;
    n_chars follows where it is there. Null texts stay null, empty ones empty, very long ones are scanned whole; repeated
    rows and null ids stay, further columns come along; an empty table gives no rows."""
    names = docs.columns
    text_at, size_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        for b in batches:
            texts, cols = b.column(text_at).to_pylist(), list(b.columns)
            found = [own for part in in_blocks(b.column(text_at)) for own in find_all(part)]
            for i, own in enumerate(found):
                if own:
                    out, at = [], 0
                    for _, s, e, _v in own:
                        if s >= at:
                            out += [texts[i][at:s], "[SECRET]"]
                        at = max(at, e)
                    texts[i] = "".join(out) + texts[i][at:]
            cols[text_at] = pa.array(texts, cols[text_at].type)
            if size_at >= 0:
                sizes = b.column(size_at).to_pylist()
                cols[size_at] = pa.array([len(texts[i]) if own else sizes[i] for i, own in enumerate(found)], cols[size_at].type)
            trim()
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def digest(found: DataFrame, base: tuple[str, ...], *more: Column) -> DataFrame:
    """doc_id, a count for each base kind, the hash of the base spans, all spans."""
    own = F.filter("spans", lambda x: x["kind"].isin(*base))
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *count, sha_of(joined(own)).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *more)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_spans(load(spark, sf_dir, "documents")), BASE)
