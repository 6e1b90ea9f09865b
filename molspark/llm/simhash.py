"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's popcounts over 32 two-bit segments form a vector whose Manhattan distance to another
never exceeds the Hamming distance of the fingerprints. Vectors within Manhattan distance 3 differ in
at most 3 segments, so of 6 groups of segments at least 3 agree: each fingerprint is put into the 20
grid cells named by three groups' counts, and whatever links lies in a common cell. Within a cell the
Manhattan bound is applied first, then the exact Hamming distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, mix64, small_batches, text_key, trim, with_labels
from .components import EDGES, SCHEMA, Forest, blocks_of_equal, connected_components

SEED, LIMIT, SHINGLE = 42, 3, 3
GROUPS, AGREE = 6, 3
#: Fingerprints of a cell that one block compares; larger cells are dealt out as pairs of blocks.
BLOCK = 8192
#: Cells up to this size are compared together, a distance along the sorted rows at a time; longer ones one by one.
SHORT = 64
LOW = np.uint64(0x5555555555555555)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bit i is 1 if set in over half of the shingles' XXH64 values; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), SEED)
    grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(width)), strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 4096):
        h = np.array([digest(g, SEED) for g in grams[at : at + 4096]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        values = (fingerprint((t.as_py() or "").encode()) for t in b.column(1))
        fp = np.fromiter(values, np.uint64, len(b)).view(np.int64)
        trim()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, fp long) of every row; a null text has no words and so the fingerprint 0. keyed: text_key besides."""
    own, schema = [F.col("doc_id").cast("long"), F.col("text").cast("string")], "doc_id long, fp long"
    if keyed:
        own, schema = [*own, text_key().alias("text_key")], f"{schema}, text_key long"
    return docs.select(*own).mapInArrow(_fingerprints, schema)


def counts(fp: np.ndarray) -> np.ndarray:
    """The popcounts of the 32 two-bit segments, each in its own two bits."""
    return (fp & LOW) + ((fp >> np.uint64(1)) & LOW)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of packed popcount vectors; fields hold 0 to 2."""
    high = LOW << np.uint64(1)
    # |x-y| of fields 0..2: 2 where one is 2 and the other 0, else their parity's difference
    odd = (a ^ b) & LOW
    two = (a ^ b) & high & ~(odd << np.uint64(1))
    return np.bitwise_count(odd).astype(np.int64) + 2 * np.bitwise_count(two).astype(np.int64)


def _masks() -> list[np.uint64]:
    bounds = [round(32 * g / GROUPS) * 2 for g in range(GROUPS + 1)]
    part = [((1 << bounds[g + 1]) - 1) ^ ((1 << bounds[g]) - 1) for g in range(GROUPS)]
    return [np.uint64(sum(part[g] for g in c)) for c in combinations(range(GROUPS), AGREE)]


def cells_of(fp: np.ndarray) -> np.ndarray:
    """A row for each of the 20 choices of groups: the cell's 64-bit key."""
    c = counts(fp)
    return np.stack([mix64((c & m) ^ mix64(np.array([k + 1], np.uint64))) for k, m in enumerate(_masks())])


def _cells(batches):
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        keys = cells_of(fp.view(np.uint64))
        for k in keys:
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(fp)], names=["cell", "fp"])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ok = manhattan(counts(a), counts(b)) <= LIMIT
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= LIMIT
    return ok


def _compare(forest: Forest, own: np.ndarray, other: np.ndarray | None = None) -> None:
    """Joins what links within ``own``, or between ``own`` and ``other``, in slices of bounded size."""
    to = own if other is None else other
    ends, c_to = to.view(np.int64), counts(to)
    for i, x in enumerate(own):
        at = i + 1 if other is None else 0
        hits = np.flatnonzero(manhattan(c_to[at:], counts(own[i : i + 1])) <= LIMIT) + at
        hits = hits[np.bitwise_count(to[hits] ^ x) <= LIMIT]
        for j in hits:
            forest.join(int(own[i : i + 1].view(np.int64)[0]), int(ends[j]))


def _links(batches):
    """Rows sorted by (cell, side): spanning links of each cell. side: 0 = compare all; of a pair of blocks, 1 and 2."""
    forest = Forest()

    def settle(cell: np.ndarray, fp: np.ndarray, side: np.ndarray) -> None:
        bounds = blocks_of_equal(cell)
        size = np.diff(bounds)
        short = np.repeat(size <= SHORT, size)
        for k in range(1, int(min(SHORT, size.max(initial=0)))):
            same = (cell[k:] == cell[:-k]) & short[k:]
            same &= ~((side[k:] > 0) & (side[k:] == side[:-k]))
            at = np.flatnonzero(same)
            ok = at[near(fp[at], fp[at + k])]
            for a, b in zip(fp[ok].view(np.int64).tolist(), fp[ok + k].view(np.int64).tolist(), strict=True):
                forest.join(a, b)
        for g in np.flatnonzero(size > SHORT):
            own, s = fp[bounds[g] : bounds[g + 1]], side[bounds[g] : bounds[g + 1]]
            if s[0]:
                _compare(forest, own[s == 1], own[s == 2])
            else:
                _compare(forest, own)

    held: list[np.ndarray] | None = None
    for b in batches:
        now = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)]
        if not len(now[0]):
            continue
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = int(np.searchsorted(-(held[0] != held[0][-1]).astype(np.int8), 0))  # where the open cell begins
        if last:
            settle(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    if held is not None:
        settle(*held)
    held = None
    trim()
    u, v = forest.stars()
    for i in range(0, len(u), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000], pa.int64()), pa.array(v[i : i + 100_000], pa.int64())], schema=SCHEMA)


def fingerprint_links(reps: DataFrame) -> DataFrame:
    """Spanning links (u, v) among distinct fingerprints (column fp) that differ in at most 3 bits."""
    cells = reps.select("fp").mapInArrow(_cells, "cell long, fp long")
    large = cells.groupBy("cell").count().where(F.col("count") > BLOCK).select(F.col("cell").alias("big"), F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    dealt = cells.join(large, F.col("cell") == F.col("big"), "left")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int")
    pairs = F.expr("transform(sequence(0, n - 1), j -> named_struct('cell', xxhash64(cell, least(j, own), greatest(j, own)), 'side', if(j = own, 0, if(own < j, 1, 2))))")
    one = F.array(F.struct(F.col("cell"), F.lit(0).alias("side")))
    rows = dealt.withColumn("own", own).select("fp", F.explode(F.when(F.col("n").isNull(), one).otherwise(pairs)).alias("x")).select("x.cell", "fp", "x.side")
    return rows.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_links, EDGES)


def grouped(spark: SparkSession, docs: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row, with text_key if ``keyed``; root names the row's component."""
    scratch = Scratch(small_batches(spark))
    fp = scratch.save(fingerprints(docs, keyed), "fingerprints")
    reps = scratch.save(fp.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = connected_components(spark, fingerprint_links(reps), scratch)
    of = reps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    label = scratch.save(of.join(least, F.col("root") == F.col("r")).select("fp", "root", "component_id", "n"), "labels")
    return with_labels(fp, label, "fp")


def simhash(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    Rows keep their number: repeated rows and null ids stay; an empty table gives no rows. A null or wordless text
    has fingerprint 0, which links like any other; a very long one is read whole. component_id is the smallest non-null doc_id reachable over links
    of at most 3 differing bits (null where a component has only null ids). Other columns are not read.
    """
    return grouped(spark, docs).select("doc_id", "fp", "component_id")


def one_of_each_group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of each component exactly one row of ``docs`` stays, with all its columns: that of the least doc_id
    (a null id only where there is no other; of rows that share the id, by the text's hash). Groups are
    told apart by their fingerprints, so different texts under one id or without an id each keep a row."""
    id_, null, key = "__simhash_id", "__simhash_null", "__simhash_key"
    pick = F.struct(F.col("doc_id").isNull().alias(null), F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("text_key").alias(key))
    first = grouped(spark, docs, keyed=True).groupBy("root").agg(F.min(pick).alias("pick")).select("pick.*")
    own = docs.withColumns({null: F.col("doc_id").isNull(), id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), key: text_key()})
    return own.join(first, [null, id_, key]).dropDuplicates([null, id_, key]).select(*docs.columns)  # one shuffle of the texts, by key


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(spark, load(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
