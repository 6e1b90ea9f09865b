"""Personal data in DataFrame expressions only: patterns propose spans, check sums confirm them, words nearby move the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .secrets import digest

BASE = ("email", "ip", "card", "phone")
_LOCAL, _PART = "[A-Za-z0-9._%+-]", r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Where a match may begin anywhere in a run of its first characters, it is held to the run's start or the
#: last match's end, which gives the same matches in linear time; possessive quantifiers where no retry can help.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # the first four characters, so that no match swallows the next one's; then, looked ahead at, all that may belong to it, and the letter or digit behind
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))",
}
#: Length of a country's IBANs; other codes may have 15 to 34 characters.
IBAN = dict(zip(*[iter("""AD 24 AE 23 AL 28 AT 20 AZ 28 BA 20 BE 16 BG 22 BH 22 BI 27 BR 29 BY 28 CH 21 CR 22 CY 28 CZ 24 DE 22 DJ 27 DK 18 DO 28 EE 20 EG 29
 ES 24 FI 18 FK 18 FO 18 FR 27 GB 22 GE 22 GI 23 GL 18 GR 27 GT 28 HN 28 HR 21 HU 28 IE 22 IL 23 IQ 23 IS 26 IT 27 JO 30 KW 30 KZ 20 LB 28 LC 32 LI 21 LT 20
 LU 20 LV 21 LY 25 MC 27 MD 24 ME 22 MK 19 MN 20 MR 27 MT 31 MU 30 NI 28 NL 18 NO 15 OM 23 PK 24 PL 28 PS 29 PT 25 QA 29 RO 24 RS 22 RU 33 SA 24 SC 31 SD 18
 SE 24 SI 19 SK 24 SM 27 ST 25 SV 28 TL 23 TN 24 TR 26 UA 29 VA 22 VG 24 XK 20 YE 30""".split())] * 2, strict=True))
#: Score of a confirmed span, and the words that raise it by BOOST among the NEAR characters before it or the AFTER
#: characters behind it, up to the next match of its kind.
CONTEXT = {
    "email": (0.8, r"\b(?:e-?mail|contact|write to)\b"),
    "ip": (0.5, r"\b(?:ip|host|server|address)\b"),
    "card": (0.7, r"\b(?:card|visa|credit|payment|amex)\b"),
    "phone": (0.6, r"\b(?:phone|tel|call|fax|mobile)\b"),
    "iban": (0.8, r"\b(?:iban|bank|account|konto)\b"),
}
BOOST, NEAR, AFTER = 0.2, 40, 20
#: Items that an array grows to before it is set aside: an append copies it, so a long text's spans stay linear.
STEP = 512


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def luhn(digits: str) -> str:
    return f"aggregate(transform(sequence(1, length({digits})), i -> cast(substring(reverse({digits}), i, 1) as int) * if(i % 2 = 0, 2, 1)), 0, (a, x) -> a + if(x > 9, x - 9, x)) % 10 = 0"


def mod97(compact: str) -> str:
    turned = f"concat(substring({compact}, 5), substring({compact}, 1, 4))"
    return f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (a, c) -> if(c between '0' and '9', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1"


def confirmed(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"{m} rlike {_quoted(rf'^0*{_PART}(?:[.]0*{_PART}){{3}}$')}"
    if kind == "card":
        return f"length({digits}) between 14 and 19 and {luhn(digits)}"
    if kind == "phone":
        return f"length({digits}) between 10 and 15"
    return f"{m} is not null"


def gathered(items: str, kind: str, item: str, after: str, unless: str = "false") -> str:
    """Goes along an array (x) with a number ``a.at`` from 0, which ``after`` moves on; the array of ``item``, of a type
    ``kind``. Where ``unless`` holds, x is passed over."""
    full = f"size(a.own) >= {STEP}"
    return f"""aggregate({items}, named_struct('at', 0L, 'done', cast(array() as array<array<{kind}>>), 'own', cast(array() as array<{kind}>)), (a, x) -> if({unless}, a, named_struct(
        'at', {after}, 'done', if({full}, array_append(a.done, a.own), a.done), 'own', if({full}, array({item}), array_append(a.own, {item})))), a -> flatten(array_append(a.done, a.own)))"""


def _ibans(spans: str) -> str:
    """Candidates cut to the IBAN that they begin with: the longest piece up to a token's end that has the country's
    length, if that is known, and passes mod-97; null if there is none. What begins inside the IBAN before is left out."""
    lengths = ", ".join(f"'{c}', {n}" for c, n in IBAN.items())
    compact = "replace(substring(s.value, 1, e), ' ', '')"
    fits = f"length({compact}) between coalesce(element_at(map({lengths}), substring(s.value, 1, 2)), 15) and coalesce(element_at(map({lengths}), substring(s.value, 1, 2)), 34)"
    ends = "substring(s.value, e, 1) <> ' ' and not substring(s.value, e + 1, 1) rlike '[A-Za-z0-9]'"
    best = f"array_max(filter(sequence(15, length(s.value)), e -> if({ends}, if({fits}, {mod97(compact)}, false), false)))"
    cut = f"filter(transform({spans}, s -> named_struct('s', s, 'n', {best})), t -> t.n is not null)"
    whole = f"transform({cut}, t -> named_struct('start', t.s.start, 'value', substring(t.s.value, 1, t.n), 'near', t.s.near))"
    return gathered(whole, "struct<start:bigint,value:string,near:string>", "x", "x.start + length(x.value)", "x.start < a.at")


def pieces(kind: str) -> Column:
    """The column ``text`` cut at the pattern's matches, null without one. Of each piece: its length (n), its ends in
    lower case (first, last), the match behind it (hit; null at the end) and all that may belong to that (value)."""
    pattern = _quoted(PATTERNS[kind])
    own = f"transform(split(text, {pattern}, -1), g -> named_struct('n', length(g), 'first', lower(left(g, {AFTER})), 'last', lower(right(g, {NEAR}))))"
    hits = f"regexp_extract_all(text, {pattern}, 0)"
    if kind == "iban":
        hits = f"zip_with({hits}, regexp_extract_all(text, {pattern}, 1), (h, m) -> named_struct('hit', h, 'value', concat(h, m)))"
    else:
        hits = f"transform({hits}, h -> named_struct('hit', h, 'value', h))"
    return F.expr(f"case when text rlike {pattern} then zip_with({own}, {hits}, (g, h) -> named_struct('n', g.n, 'first', g.first, 'last', g.last, 'hit', h.hit, 'value', h.value)) end")


def spans_of(kind: str) -> Column:
    """Confirmed spans of one kind from the column of its ``pieces``, which give the places and the words nearby."""
    score, words = CONTEXT[kind]
    starts = gathered(kind, "bigint", "a.at + x.n", "a.at + x.n + coalesce(length(x.hit), 0)")
    placed = f"zip_with({kind}, {starts}, (x, s) -> named_struct('start', s, 'value', x.value, 'last', x.last))"
    nearby = f"zip_with({placed}, slice({kind}, 2, greatest(size({kind}) - 1, 0)), (x, y) -> named_struct('start', x.start, 'value', x.value, 'near', concat_ws(chr(10), x.last, y.first)))"
    found = f"filter({nearby}, s -> if(s.value is null, false, {confirmed(kind, 's.value')}))"
    if kind == "iban":
        found = _ibans(found)
    scored = f"transform({found}, s -> named_struct('kind', '{kind}', 'start', s.start, 'end', s.start + length(s.value), 'value', s.value, 'score', if(s.near rlike {_quoted(words)}, {score + BOOST:.1f}D, {score}D)))"
    return F.expr(f"coalesce({scored}, cast(array() as array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>))")


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of ``docs``: kind, start, end (code points, end exclusive), value, score,
    by start, then kind as listed. A null text counts as empty and has no spans; a very long text, however many
    spans it has, takes time in proportion; an empty table gives no rows; repeated rows and null ids stay; other
    columns are not read."""
    order = F.array(*map(F.lit, PATTERNS))
    every = F.concat(*(F.col(k) for k in PATTERNS))
    sorted_ = F.array_sort(every, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise((F.array_position(order, a["kind"]) - F.array_position(order, b["kind"])).cast("int")))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = texts.select("doc_id", *(pieces(k).alias(k) for k in PATTERNS))
    return cut.select("doc_id", *(spans_of(k).alias(k) for k in PATTERNS)).select("doc_id", sorted_.alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans' digest, and the spans' scores in their order."""
    found = pii_spans(load(spark, sf_dir, "documents"))
    scores = F.concat_ws(",", F.transform("spans", lambda x: F.format_string("%.1f", x["score"])))
    return digest(found, BASE, scores.alias("scores"))
