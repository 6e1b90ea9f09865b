"""Fill-in-middle by escaped marker injection, in column expressions.

The delimiter is escaped in the text; a regular expression then appends it after every unit. Its number is
the number of units, and ``substring_index`` takes the parts between two of them. Parts lose the
delimiter, are unescaped and assembled around sentinels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, text_of

#: What a text may be cut between, by name. None of them parts an escape from its letter but the first, which has it as a unit.
UNITS = {"code points": r"(?s:.)", "words": r"\S+\s*|\s+", "lines": r"[^\n]*\n|[^\n]+"}
DELIMITER, ESCAPE = "\x01", "\x02"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are transformed, and of these with the suffix first; the salt of the hash that picks them.
RATE, SUFFIX_FIRST, SALT = 90, 20, "1"


def picks(salt: str = SALT, n: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the hash of the row's id (null: as an empty one)."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(DELIMITER), F.lit(ESCAPE + "a"))


def unescaped(part: Column) -> Column:
    """A part of a marked text as it was."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "a"), F.lit(DELIMITER)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))


def head(marked: Column, units: Column) -> Column:
    """The first units of a marked text, without the last one's delimiter."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), units)


def tail(marked: Column, units: Column) -> Column:
    """The units after the delimiter with this number from the end."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), -units)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. As no text with a sentinel is transformed, each occurs once and none can
    arise where parts meet."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, units: str = "code points", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, salt: str = SALT) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) for each row of ``docs`` (doc_id, text): its number of units, and its
    parts and their assembly as ``psm`` or ``spm``; a ``plain`` row has null parts and its text as output.

    Cuts and form follow a hash of the id, so reruns agree; rows that share an id, or have none, are cut by the same
    numbers, each for itself. A null text counts as an empty one, which is plain, as is one with a sentinel in it. Texts
    of any length and content are taken whole, control characters too. Lines and words keep what ends them. An empty
    table gives no rows; other columns are not read. No shuffle.
    """
    h = picks(salt)
    text = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    text = text.select("doc_id", "text", escaped(F.col("text")).alias("escaped"))
    marked = text.select("doc_id", "text", "escaped", F.regexp_replace("escaped", f"{ESCAPE}[ab]|{UNITS[units]}", f"$0{DELIMITER}").alias("marked"))
    counted = marked.select("doc_id", "text", "marked", (F.length("marked") - F.length("escaped")).cast("long").alias("n"))
    a, b = (x % (F.col("n") + 1) for x in h[:2])
    whole = (F.col("text") == "") | (h[2] % 100 >= rate)
    for s in (PREFIX, SUFFIX, MIDDLE):
        whole = whole | F.contains("text", F.lit(s))
    form = F.when(whole, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    cut = counted.select("doc_id", "text", "marked", "n", form.alias("form"), F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b"))
    here = F.col("form") != "plain"
    m, a, b = F.col("marked"), F.col("a"), F.col("b")
    made = {"prefix": head(m, a), "middle": tail(head(m, b), b - a), "suffix": tail(m, (F.col("n") - b + 1).cast("int"))}
    parts = cut.select("doc_id", "text", "n", "form", *(F.when(here, unescaped(p)).alias(name) for name, p in made.items()))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(load(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", *(F.length(p).cast("long").alias(f"{p}_chars") for p in ("prefix", "middle")),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
