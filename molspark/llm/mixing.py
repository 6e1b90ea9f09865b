"""Mixing sources to target weights: a time-varying curriculum in DataFrame expressions only.

Each source has a weight schedule over training time 0..1 (piecewise linear). Its integral gives the
source's demand for tokens up to any time; inverting that for the words that come before a document
in its source gives the document's training position. Positions sort the documents by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT, WORD, Scratch, load, text_key

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEATS = 1.5, 2
Schedule = Sequence[tuple[float, float]]
#: (time, relative weight) knots by the source's place in WEIGHTS; each integrates to 1, so that a source's weight is its schedule's mean.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Hex digits of the order key that deal a source's documents into independent prefix sums, and those sums into wider ones.
SPREAD, WIDE = 4, 2
#: Of more copies of one row than these, each so many are placed by a task of their own.
SLOT = 1024


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def invert(schedule: Schedule, share: Column) -> Column:
    """The time at which the schedule's integral reaches ``share`` of its whole."""
    pieces = [(t0, t1, v0, v1, (v0 + v1) / 2 * (t1 - t0)) for (t0, v0), (t1, v1) in zip(schedule, schedule[1:], strict=False)]
    total, done, out = sum(p[4] for p in pieces), 0.0, None
    for t0, t1, v0, v1, area in pieces:
        y, slope = share * F.lit(total) - F.lit(done), (v1 - v0) / (t1 - t0)
        root = F.lit(v0) + F.sqrt(F.greatest(F.lit(v0 * v0) + F.lit(2 * slope) * y, F.lit(0.0)))
        at = F.least(F.lit(t1), F.lit(t0) + F.coalesce(F.try_divide(F.lit(2.0) * y, root), F.lit(t1 - t0)))
        done += area
        here = share * F.lit(total) <= F.lit(done)
        out = F.when(here, at) if out is None else out.when(here, at)
    return out.otherwise(F.lit(schedule[-1][0]))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """(key, source_size, class, target) by source: ``share`` of all words by weight, no source above ``repeats`` times its size.

    A source is at its cap where its cap per weight is below the water level; the level is the first,
    in order of cap per weight, at which the rest fits.
    """
    per = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("class", ((rank - 1) % len(weights)).cast("int"))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1)).withColumn("cap", F.col("source_size").cast("double") * F.lit(float(repeats)))
    every, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("all_w", F.sum("w").over(every)).withColumn("budget", F.sum("source_size").over(every).cast("double") * F.lit(share))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("key"), F.col("level").alias("level")))).over(every)["level"])
    return per.select("key", "source_size", "class", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def curriculum(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, repeats: int = REPEATS, scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, position.

    Sizes are words (null or wordless text: 0). Sources rank by code point, null last as a source of
    its own; an empty table gives no rows. Within a source, documents follow the md5 of their id and text
    (null: empty), ties by id and size, so reruns agree; the mix takes whole documents in that order, over
    again up to ``repeats`` times, and cuts the one that reaches the target. position is that of the
    document's first word in 0..1, and above 1 for documents not taken; each later pass has its own (``passes``).
    Of very long texts the words are counted like any other's. Only the three columns are read, so further columns of any name do no harm.
    """
    return _mix(spark, docs, weights, schedules, share, repeats, scratch).drop("key", "text_key", "class", "at")


def _mix(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, repeats: int = REPEATS, scratch: Scratch | None = None) -> DataFrame:
    """curriculum() with the source's key and class, the text's hash, and the words of the source before the row (at)."""
    placed, sizes = _placed(spark, docs, weights, share, repeats, scratch or Scratch(spark))
    own = ["doc_id", "size", "source_size", "class", "target", "key", "text_key"]
    rows = placed.where(F.col("copies") <= SLOT).select(*own, F.explode(copies(F.lit(0), F.col("copies"))).alias("at"))
    if not sizes.where(F.col("copies") > SLOT).isEmpty():  # else no row need travel once more
        first = F.col("slot") * SLOT
        slots = placed.where(F.col("copies") > SLOT).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / SLOT)))).repartition("h", "slot")
        rows = rows.unionByName(slots.select(*own, F.explode(copies(first, F.least(F.col("copies"), first + SLOT))).alias("at")))
    rest = F.floor(F.col("target") + F.lit(0.5)) - F.col("at")
    taken = sum((F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("source_size") * p)) for p in range(repeats)), F.lit(0))
    unplaced = F.lit(1.0) + F.coalesce(F.try_divide(F.col("at").cast("double"), F.col("source_size").cast("double")), F.lit(0.0))
    position = F.when((rest > 0) & (F.col("size") > 0), placed_at(F.col("at"), weights, schedules)).otherwise(F.round(unplaced, 9))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), position.alias("position"), "key", "text_key", "class", "at")


def copies(first: Column, end: Column) -> Column:
    """The words of the source before each of a row's copies from number ``first`` up to ``end``."""
    return F.transform(F.sequence(first.cast("long"), end.cast("long") - 1), lambda i: F.col("at") + i * F.col("size"))


def _placed(spark: SparkSession, docs: DataFrame, weights: Sequence[float], share: float, repeats: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """A row for all rows of ``docs`` that are alike in id, source and text: doc_id, size, source_size, target, its source's key and
    class, the text's hash, h (the order's hash), the words of the source before the first of them (at), and their number (copies),
    which tasks add up before rows travel, so that copies never meet in one. As the order's hash takes in the text, rows that
    share an id or have none are dealt out like any others. Also the table of sizes that this is made from."""
    key = source_key()
    text_hash = F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit(""))
    h = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_hash).cast("binary"))
    sized = docs.select("doc_id", F.col("source").cast("string"), key.alias("key"), word_count(F.col("text")).alias("size"), h.alias("h"), text_key().alias("text_key"))
    sized = scratch.save(sized.groupBy("doc_id", "source", "key", "size", "h", "text_key").agg(F.count("*").alias("copies")), "sizes")
    sized, words = sized.withColumn("part", F.substring("h", 1, SPREAD)), F.col("size") * F.col("copies")
    inner = Window.partitionBy("key", "part").orderBy("h", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("inner", F.sum(words).over(inner) - words)
    parts = sized.groupBy("key", "part").agg(F.sum(words).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("wide", F.substring("part", 1, WIDE))  # a source's parts are added up in wider ones first
    wide = parts.groupBy("key", "wide").agg(F.sum("n").alias("n")).select("key", "wide", before(Window.partitionBy("key").orderBy("wide")).alias("from"))
    fine = parts.select("key", "part", "wide", before(Window.partitionBy("key", "wide").orderBy("part")).alias("fine"))
    bases = fine.join(wide, ["key", "wide"]).select("key", "part", (F.col("from") + F.col("fine")).alias("base"))
    per = source_targets(sized.withColumn("size", words), weights, share, repeats)
    rows = placed.join(bases.join(per, "key"), ["key", "part"]).withColumn("at", F.col("inner") + F.col("base"))
    return rows.select("doc_id", "size", "source_size", "target", "key", "text_key", "class", "h", "at", "copies"), sized


def placed_at(at: Column, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Schedule] = SCHEDULES, prefix: str = "") -> Column:
    """The training position at which a source has given ``at`` words, by the row's class and target."""
    share_at, position = F.coalesce(F.try_divide(at.cast("double"), F.col(f"{prefix}target")), F.lit(0.0)), None
    for k in range(len(weights)):
        here, found = F.col(f"{prefix}class") == k, F.round(invert(schedules[k % len(schedules)], share_at), 9)
        position = F.when(here, found) if position is None else position.when(here, found)
    return position


def passes(repeats: int = REPEATS, prefix: str = "") -> Column:
    """Of a row with size, source_size, class, target and at: an array with (pass from 0, position, words, whole) for each
    pass over its source that takes words of it. Each pass has the position at which the source's demand reaches it."""
    made = []
    for p in range(repeats):
        begins = F.col(f"{prefix}at") + F.col(f"{prefix}source_size") * p
        words = F.least(F.col(f"{prefix}size"), F.floor(F.col(f"{prefix}target") + F.lit(0.5)) - begins).cast("long")
        made.append(F.struct(F.lit(p).alias("pass"), placed_at(begins, prefix=prefix).alias("position"), words.alias("words"), (words == F.col(f"{prefix}size")).alias("whole")))
    return F.filter(F.array(*made), lambda x: x["words"] > 0)


def range_sorted(mixed: DataFrame) -> DataFrame:
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_sorted(curriculum(spark, load(spark, sf_dir, "documents")))


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in the mix's order: each once for every pass over its source that takes it, at that pass's
    own position, the last one cut to the words taken; rows not taken left out. n_chars follows the text.

    Null, empty and wordless texts are never taken; an empty table gives no rows. Rows that share an id, or have
    none, but differ in text or source are taken each for itself. Of rows alike in all three, which the mix can't tell
    apart, one stands for all and is repeated as often as the mix takes them. Further columns come along, whatever their names."""
    id_, row, n, each, cut, slot = (f"__mix_{x}" for x in ("id", "row", "n", "pass", "text", "slot"))
    own_key = {id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), row: F.xxhash64(F.col("doc_id").isNull(), source_key(), text_key())}
    mix_key = [own_key[id_].alias(id_), F.xxhash64(F.col("doc_id").isNull(), F.col("key"), F.col("text_key")).alias(row)]
    facts = ["size", "source_size", "class", "target", "at"]
    scratch = Scratch(spark)
    placed, _ = _placed(spark, docs, WEIGHTS, SHARE, REPEATS, scratch)
    placed = placed.select(*mix_key, F.col("copies").alias(n), *facts)
    placed = scratch.save(placed.groupBy(id_, row).agg(F.sum(n).alias(n), *(F.min(c).alias(c) for c in facts)), "placed")
    own, single = docs.withColumns(own_key), placed.where(F.col(n) == 1).select(id_, row, passes().alias(each)).where(F.size(each) > 0)
    if (alike := placed.where(F.col(n) > 1)).isEmpty():  # then no text need be looked at for copies
        rows = own.join(single, [id_, row])
    else:
        total = placed.agg(F.sum(n)).first()[0]
        often = F.col(n) * HOT >= total  # HOT rows of it at most: these go to the copies, which tasks thin out before texts travel
        hot, rest = F.broadcast(alike.where(often)), alike.where(~often)
        others = own.join(F.broadcast(alike.where(often).select(id_, row)), [id_, row], "left_anti")
        first = own.join(F.broadcast(alike.where(often).select(id_, row)), [id_, row]).groupBy(id_, row).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(cut))
        one = first.join(hot, [id_, row]).select(id_, row, f"{cut}.*", n, *(F.col(c).alias(f"__mix_{c}") for c in facts))
        some = others.join(rest.select(id_, row, n, *(F.col(c).alias(f"__mix_{c}") for c in facts)), [id_, row]).dropDuplicates([id_, row])
        one = one.unionByName(some.select(*one.columns)).withColumn(slot, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / SLOT))))
        one = one.repartition(id_, row, slot)  # about SLOT copies to a slot
        begins = F.explode(F.sequence(F.col(slot) * SLOT, F.least(F.col(n), (F.col(slot) + 1) * SLOT) - 1))
        many = one.withColumn(slot, begins).withColumn("__mix_at", F.col("__mix_at") + F.col(slot) * F.col("__mix_size"))
        many = many.withColumn(each, passes(prefix="__mix_")).where(F.size(each) > 0)
        rows = others.join(single, [id_, row]).select(id_, row, *docs.columns, each).unionByName(many.select(id_, row, *docs.columns, each))
    rows = rows.withColumn(each, F.explode(each))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    text = F.when(F.col(f"{each}.whole"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col(f"{each}.words").cast("int")), " "))
    out = rows.withColumn(cut, text)
    cols = [F.col(cut).alias("text") if c == "text" else F.length(cut).cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    order = [f"{each}.position", id_, row, f"{each}.pass"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*cols)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, ''), '|', coalesce(md5(text), ''))) AS h FROM documents),
per AS (
  SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 AS class FROM per),
weighed AS (
  SELECT *, CASE class WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS w, source_size::DOUBLE * 2::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0::DOUBLE)) AS lev
  FROM weighed WINDOW b AS (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT lev FROM levels WHERE lev <= cap / w ORDER BY cap / w, key LIMIT 1),
targets AS (
  SELECT key, source_size, class, least(cap, coalesce((SELECT lev FROM level) * w, cap)) AS target FROM levels),
run AS (
  SELECT s.doc_id, s.size, t.source_size, t.class, t.target,
         (sum(s.size) OVER (PARTITION BY s.key ORDER BY s.h, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - s.size AS pos
  FROM sized s JOIN targets t USING (key)),
shares AS (
  SELECT *, floor(target + 0.5::DOUBLE)::BIGINT - pos AS rest, CASE WHEN target > 0 THEN pos::DOUBLE / target ELSE 0::DOUBLE END AS x FROM run),
times AS (
  SELECT *, CASE class
    WHEN 0 THEN CASE WHEN x <= 0.625::DOUBLE THEN least(0.5::DOUBLE, 2::DOUBLE * x / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2::DOUBLE * x, 0::DOUBLE))))
                     WHEN x <= 1 THEN least(1::DOUBLE, 0.5::DOUBLE + 2::DOUBLE * (x - 0.625::DOUBLE) / (1::DOUBLE + sqrt(greatest(1::DOUBLE - 2::DOUBLE * (x - 0.625::DOUBLE), 0::DOUBLE)))) ELSE 1::DOUBLE END
    WHEN 1 THEN CASE WHEN x <= 1 THEN least(1::DOUBLE, 2::DOUBLE * x / 2::DOUBLE) ELSE 1::DOUBLE END
    ELSE CASE WHEN x <= 0.375::DOUBLE THEN least(0.5::DOUBLE, 2::DOUBLE * x / (0.5::DOUBLE + sqrt(greatest(0.25::DOUBLE + 2::DOUBLE * x, 0::DOUBLE))))
              WHEN x <= 1 THEN least(1::DOUBLE, 0.5::DOUBLE + 2::DOUBLE * (x - 0.375::DOUBLE) / (1::DOUBLE + sqrt(greatest(1::DOUBLE + 2::DOUBLE * (x - 0.375::DOUBLE), 0::DOUBLE)))) ELSE 1::DOUBLE END
    END AS t FROM shares)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(0, rest)) + least(size, greatest(0, rest - source_size)))::BIGINT AS taken,
       round(CASE WHEN rest > 0 AND size > 0 THEN t ELSE 1::DOUBLE + CASE WHEN source_size > 0 THEN pos::DOUBLE / source_size::DOUBLE ELSE 0::DOUBLE END END, 9) AS position
FROM times
"""
