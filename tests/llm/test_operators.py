import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspark.llm import ann, common, langid, lm, mixing, neardup, packing, pii, secrets, simhash, toxicity
from molspark.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, score string"
ODD = [
    (1, None, None, None, 0, 7, "x", "s"),
    (2, "", "en", "a", 0, 7, "x", "s"),
    (3, "   \n\t", "en", "a", 5, 7, "x", "s"),
    (4, "word " * 30_000, "en", "a", 150_000, 7, "x", "s"),
    (5, "one two three four five", "fr", "b", 23, 7, "x", "s"),
    (5, "one two three four five", "fr", "b", 23, 7, "x", "s"),
    (None, "one two three four five", "fr", "b", 23, 7, "x", "s"),
    (7, "x" * 70_000, "de", "é", 70_000, 7, "x", "s"),
    (8, "Ünï ✓ 日本 token: abcdef123456", "de", None, 30, 7, "x", "s"),
]


def texts(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, data, agree, name):
    agree(QUERIES[name](spark, data), ORACLES[name])


def run_all(spark, docs):
    labels = spark.createDataFrame([(2, 1, 1), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    held = toxicity.model(spark, docs, labels)
    lang = langid.model(spark, docs)
    return {
        "mix": mixing.curriculum(spark, docs), "toxicity": toxicity.toxicity(docs, held), "lm": lm.lm_scores(spark, docs), "secrets": secrets.secret_spans(docs),
        "pii": pii.pii_spans(docs), "langid": langid.identify(docs, lang), "simhash": simhash.simhash(spark, docs),
    }


def test_odd_rows(spark):
    got = {k: df.collect() for k, df in run_all(spark, texts(spark)).items()}
    assert {k: len(v) for k, v in got.items()} == dict.fromkeys(got, len(ODD))
    assert {r.lang_pred for r in got["langid"] if r.doc_id in (1, 2, 3)} == {"und"}
    assert len({r.component_id for r in got["simhash"] if r.doc_id in (1, 2, 3)}) == 1
    assert all(0 <= r.score <= 1 for r in got["toxicity"])
    assert all(r.taken <= 2 * r.size for r in got["mix"])
    packed = packing.pack(spark, texts(spark)).collect()
    assert sum(r.length for r in packed if r.doc_id in (1, 2, 3)) == 3 and {r.doc_tokens for r in packed if r.doc_id == 5 and r.start == 0} == {6}


def test_empty_tables(spark):
    assert all(df.count() == 0 for df in run_all(spark, texts(spark, [])).values())
    assert packing.pack(spark, texts(spark, [])).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neardup.near_duplicates(spark, none).count() == 0 and ann.search(spark, none).count() == 0


def test_simhash_brute(spark, data):
    got = QUERIES["op8_simhash"](spark, data).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in got}
    up = {i: i for i in fp}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 3 and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    assert all(r.component_id == top(r.doc_id) for r in got)


def test_simhash_bound_and_large_cells(spark, monkeypatch):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 2000, dtype=np.uint64), rng.integers(0, 2**63, 2000, dtype=np.uint64)
    assert (simhash.manhattan(simhash.counts(a), simhash.counts(b)) <= np.bitwise_count(a ^ b)).all()
    monkeypatch.setattr(simhash, "BLOCK", 50)
    chain = [int(x) for x in {sum(1 << k for k in rng.choice(16, 3)) for _ in range(300)}]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in chain], "fp long")).collect()
    up = {x: x for x in chain}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        up[max(top(r.u), top(r.v))] = min(top(r.u), top(r.v))
    assert len({top(x) for x in chain}) == 1  # all are within three bits of the next by way of others


BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def spans(rules, text):
    return [(s, k, e) for s, _, k, e in sorted((m.start(), list(rules).index(k), k, m.end()) for k, (r, ok) in rules.items() for m in r.finditer(text) if ok(m))]


def test_secrets_brute():
    random.seed(1)
    bits = ["password", "Secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "AKIA", "AKIAABCDEFGH", "0123456789ABCDEF", "deadbeef", "0123456789abcdef", "é", "\n", "x", ".", "-", "passwd"]
    for _ in range(200):
        some = ["".join(random.choices(bits, k=random.randint(0, 25))) for _ in range(20)]
        for text, got in zip(some, secrets.find_all([t.encode() for t in some]), strict=True):
            assert [(s, k, e) for k, s, e, _ in got if k in BASE] == spans(BASE, text)


def luhn(d):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d)))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PRIVATE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m)) <= 15),
}


def test_pii_brute(spark):
    random.seed(5)
    bits = ["a", "b.c", "@", ".", "x-y", "_", "%", "+", "1", "25", "255", "256", " ", "-", "(", ")", "4111111111111111", "4111 1111 1111 1111", "+49 30 1234567", "é", "\n", "007", "300.1.1.1", "1.2.3.4", "a@b.co", "12345678901234567890"]
    some = ["".join(random.choices(bits, k=random.randint(0, 16))) for _ in range(1500)] + ["1" * 50_000, "a" * 50_000 + "@b.c"]
    rows = secrets.digest(pii.pii_spans(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")), pii.BASE).collect()
    for r in rows:
        want = ",".join(f"{k}:{s}:{e}" for s, k, e in spans(PRIVATE, some[r.doc_id]))
        assert hashlib.sha256(want.encode()).hexdigest() == r.base_sha256
    iban = pii.pii_spans(spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00")], "doc_id long, text string")).first().spans
    assert [(s.kind, s.start, s.end, s.score) for s in iban] == [("iban", 5, 32, 1.0)]


def test_ibans_before_other_words(spark):
    """An IBAN is found whatever follows it; random rows against a plain version that tries every start and end."""
    de, fr, no, one = "DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606", "NO93 8601 1117 947", "GB29NWBK60161331926819"
    ends = ["", " Please pay", " BIC COBADEFFXXX", " EUR 50 by", " 2024", " 7", f" {fr}", f" {de}", "\nX", ".", ", A1", " or", " é"]
    some = [f"{p}{i}{e}" for p in ("", "AB12 ", "DE12 ", "To ") for i in (de, de.replace(" ", ""), fr, no, one) for e in ends]
    random.seed(8)
    bits = [de, fr, no, one, "DE89", "3704", "00", "AB12", "Pay", "X", "é", "a", "GB29NWBK60161331926818", "123456789012345678901234567890"]
    some += [random.choice(["", " "]).join(random.choices(bits, k=random.randint(1, 8))) for _ in range(300)]
    some += [" ".join(random.choices(bits, k=random.randint(1, 8))) for _ in range(300)]

    def plain(text):
        found, at = [], 0
        for s in (m.start() for m in re.finditer(r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})", text)):
            fits = []
            for e in range(s + 15, min(len(text), s + 68) + 1):
                if re.fullmatch(r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}", text[s:e]) and not re.match("[A-Za-z0-9]", text[e:]):
                    c = text[s:e].replace(" ", "")
                    if len(c) == int(pii.IBAN.get(c[:2], len(c))) and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1:
                        fits.append(e)
            if s >= at and fits:
                found.append((s, at := max(fits)))
        return found

    got = pii.pii_spans(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()
    for r in got:
        assert [(s.start, s.end) for s in r.spans if s.kind == "iban"] == plain(some[r.doc_id]), some[r.doc_id]
        assert all(s.value == some[r.doc_id][s.start : s.end] for s in r.spans)
    assert plain(f"{de} Please pay") == [(0, 27)] and plain(f"{de} {fr}") == [(0, 27), (28, 55)]


def test_packing_round_trip(spark, data):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.op10_packing(spark, data).collect()
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    for d in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids, at = np.array(coder.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for own in by_window.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_window) <= sum(r.length for r in rows) / 4096 * 1.02 + 2


def test_encoder_on_odd_text():
    from tokenizers import Tokenizer

    random.seed(3)
    coder, plain = packing.SpacedEncoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    bits = ["it's", "'stuff", "A", "Été", "b—c", "—,", ".", "...", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\x1c", " ", "é", "x́,", "×", "5", "½", "日本", "'LL", "İ", "\x00"]
    for _ in range(500):
        text = "".join(random.choices(bits, k=random.randint(0, 12)))
        assert np.frombuffer(coder.encode([text.encode()])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def vectors(spark, x, ids=None):
    rows = [(int(i), [float(c) for c in v] if v is not None else None) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def components(linked):
    """The least place reachable from each."""
    at = list(range(len(linked)))
    while True:
        now = [min([at[i], *(at[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(linked))]
        if now == at:
            return at
        at = now


def test_neardup_large_cells(spark, monkeypatch):
    """Cells dealt out as pairs of blocks, and long ones: every link, counted once."""
    rng = np.random.default_rng(9)
    center = rng.standard_normal((3, 12))
    x = (center[rng.integers(0, 3, 900)] + 0.12 * rng.standard_normal((900, 12))).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cosine = u @ u.T
    np.fill_diagonal(cosine, 0)
    monkeypatch.setattr(neardup, "BLOCK", 60)
    got = {r.vec_id: r for r in neardup.near_duplicates(spark, vectors(spark, x)).collect()}
    found, linked, sure = np.array([got[i].n_links for i in range(900)]), (cosine >= 0.9).sum(1), (cosine >= 0.95).sum(1)
    assert (found <= linked).all() and (found >= sure * 0.99).all() and found.sum() >= 0.995 * linked.sum()
    assert [got[i].component_id for i in range(900)] == components(cosine >= 0.9)


def test_neardup_filter_of_fewer_projections(spark, monkeypatch):
    """Fewer projections than groups travel: no link is lost, and a row's code has no more bytes than those."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rng.standard_normal(x.shape)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    c = rng.uniform(0.901, 0.93, (400, 1))
    table = vectors(spark, np.concatenate([x, c * x + np.sqrt(1 - c * c) * turn]))
    sets = []
    for most in (8, 64):
        monkeypatch.setattr(neardup, "FILTER", most)
        sets.append(sorted(map(tuple, neardup.near_duplicates(spark, table).collect())))
    k, groups = neardup.shape(800)
    assert groups > 8 and sum(n > 0 for _, n, _, _ in sets[0]) >= 0.99 * 800
    assert sum(a != b for a, b in zip(*sets, strict=True)) <= 0.005 * 800
    rows = table.select(F.col("vec_id").alias("rep"), F.col("embedding").cast("array<double>").alias("embedding"))
    code = rows.mapInArrow(neardup._deal(k, groups, True, 8), "cell long, g int, rep long, code binary")
    assert code.agg(F.max(F.octet_length("code"))).first()[0] == 8


def test_neardup_brute(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    x = np.concatenate([x, x[:60] + 0.25 * rng.standard_normal((60, 16)), np.repeat(x[:1], 40, axis=0), x[1:30] + 0.01 * rng.standard_normal((29, 16))]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    odd = [None, [0.0] * 16, [float("nan")] * 16, []]
    got = {r.vec_id: r for r in neardup.near_duplicates(spark, vectors(spark, [*x, *odd])).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= linked.sum(1)).all() and found.sum() >= 0.99 * linked.sum()
    assert [got[i].component_id for i in range(len(x))] == components(linked)
    assert all(got[len(x) + k].n_links == 0 and got[len(x) + k].kept for k in range(4))


def test_neardup_pairs_far_apart_in_their_first_cell(spark):
    """Pairs at cosine 0.90 to 0.92 whose first shared cell holds them far apart along its first projection, and which meet again."""
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 60_000, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    c = rng.uniform(0.901, 0.92, (len(a), 1))
    b = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b, axis=1, keepdims=True)
    k, groups = neardup.shape(2)
    own = neardup.Projections(16, k, groups)
    shared, gap = own.cells(a) == own.cells(b), np.abs(own.along(a) - own.along(b))
    reach, first = neardup.SPAN * np.sqrt(0.2), shared.argmax(1)
    odd = np.flatnonzero((shared & (gap <= reach)).any(1) & (gap[np.arange(len(a)), first] > reach))[:40]
    assert len(odd) >= 20 and neardup.shape(2 * len(odd)) == (k, groups)
    few = (gap[odd] <= reach).sum(1) >= neardup.least_count(groups)
    x = np.concatenate([a[odd[few]], b[odd[few]]])
    got = {r.vec_id: r for r in neardup.near_duplicates(spark, vectors(spark, x)).collect()}
    n = len(x) // 2
    assert [i for i in range(n) if got[i].component_id != got[n + i].component_id] == []


def test_odd_vectors(spark):
    """Null ids and components, other lengths, repeated rows, zeros of either sign, clashing columns."""
    nan, inf = float("nan"), float("inf")
    x = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.05], [-1.0, 0.0], [1.0, -0.0], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [], None, [1.0, 0.0, 0.0], [1e-30, 0.0], [3e30, 1e28]]
    rows = [(i, v, 1, 2.0, 3) for i, v in enumerate(x)] + [(None, [1.0, 0.0], 1, 2.0, 3), (0, [1.0, 0.0], 1, 2.0, 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, score double, rank int")
    got = neardup.near_duplicates(spark, table).collect()
    assert len(got) == len(rows)
    alike = [i for i, v, *_ in rows if v and len(v) == 2 and i in (0, 1, 2, 4, 12, 13, None)]
    for r in got:
        if r.vec_id in alike:
            assert (r.n_links, r.component_id) == (len(alike) - 1, 0)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert sum(r.kept for r in got if r.vec_id in alike) == 2  # id 0 is there twice
    found = ann.search(spark, table).collect()
    assert sorted((r.query_id, r["rank"]) for r in found) == sorted([(0, k) for k in range(1, 6)] * 2)
    assert {r.vec_id for r in found} == {1, 2, 4, 12, 13}


def test_ann_recall(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in QUERIES["op9_ann"](spark, data).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[i] = -9
        hits.append(len(set(ids[np.lexsort((ids, -s))[:5]]) & set(got[ids[i]])))
    assert np.mean(hits) >= 4.5


def test_ann_ties(spark):
    x = [[1.0, 0.0]] * 12 + [[0.0, 1.0]]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(spark, vectors(spark, x)).collect())
    assert [v for q, _, v in got if q == 0] == [1, 2, 3, 4, 5]


def test_ann_many_ties(spark):
    """More unequal vectors of one cosine than a fixed number of candidates holds, and an id with many equal rows."""
    x = [[1.0, 0.5]] + [[2.0 ** (20 - k), 2.0 ** (19 - k)] for k in range(60)] + [[0.0, 1.0]] * 3
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(spark, vectors(spark, x[::-1], [*range(len(x))][::-1])).collect())
    assert [v for q, _, v in got if q == 0] == [1, 2, 3, 4, 5]
    many = vectors(spark, [[1.0, 0.0]] * 12 + [[0.0, 1.0]] * 4, [0] * 8 + [1, 2, 3, 4, 5, 6, 7, 8])
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(spark, many).collect())
    assert got == sorted([(0, k, v) for k, v in enumerate([1, 2, 3, 4, 5], 1)] * 8)


def test_router_probes_less_than_all():
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((8, 16))[rng.integers(0, 8, 1600)] + 0.3 * rng.standard_normal((1600, 16)))
    got = ann.fit(x / np.linalg.norm(x, axis=1, keepdims=True), 12_000)
    assert got.parts == 32 and got.probes < 16  # 250 vectors a part and 40 sampled ones at least


def test_held_out_accuracy(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op2_toxicity"](spark, big).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op7_langid"](spark, big).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.98


def test_pipeline_brute(spark, data):
    """Each stage against a plain version of its decision, on the rows that it was given."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    clean = p.reject_toxic(spark, docs, data).cache()
    held = toxicity.model(spark, docs, spark.read.parquet(f"{data}/labels.parquet"))
    kept = {r.doc_id for r in toxicity.toxicity(docs, held).collect() if r.score < toxicity.THRESHOLD}
    assert {r.doc_id for r in clean.collect()} == kept
    single = p.one_of_each_group(spark, clean, data).cache()
    groups = simhash.simhash(spark, clean).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})
    safe = p.redact_secrets(spark, single, data).cache()
    assert not any(spans(BASE, r.text) for r in safe.collect()) and safe.count() == single.count()
    mixed = p.mix_sources(spark, safe, data).cache()
    assert mixed.columns == docs.columns
    want = sum(r.taken for r in mixing.curriculum(spark, safe).collect())
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect()) == want
    assert p.pack_windows(spark, mixed, data).count() >= mixed.count()


def plain_groups(texts):
    fp, groups = [simhash.fingerprint((t or "").encode()) for t in texts], []
    for i, a in enumerate(fp):
        near = [g for g in groups if any((fp[j] ^ a).bit_count() <= 3 for j in g)]
        groups = [g for g in groups if g not in near] + [sum(near, [i])]
    return groups


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    many = [(None, f"no id here {i} apart from {i * 7} others {i * i}", "en", None, 0, 1, "x", "s") for i in range(6)]
    same_id = [(5, f"one id but {i} texts {i * 31} of it {i * i}", "en", "b", 0, 1, "x", "s") for i in range(6)]
    rows = [*ODD, *many, *same_id, *same_id[:3], *ODD[3:5]]
    single = p.one_of_each_group(spark, texts(spark, rows), None)
    kept = single.collect()
    groups = plain_groups([r[1] for r in rows])
    assert single.columns == texts(spark).columns and len(kept) == len(groups)
    for g in groups:
        first = min((rows[i] for i in g), key=lambda r: (r[0] is None, r[0] or 0))
        assert [r.doc_id for r in kept if r.text in {rows[i][1] for i in g}] == [first[0]]
    safe = p.redact_secrets(spark, texts(spark, rows), None)
    assert safe.count() == len(rows) and safe.columns == single.columns
    taken = {}
    for r in mixing._mix(spark, texts(spark, rows)).collect():
        at = (r.doc_id, r.key, r.text_key)
        taken[at] = taken.get(at, 0) + r.taken
    got = p.mix_sources(spark, texts(spark, rows), None)
    words = sorted(len(r.text.split()) for r in got.collect())
    assert got.columns == single.columns and sum(words) == sum(taken.values())
    none = texts(spark, [])
    held = toxicity.model(spark, texts(spark), spark.createDataFrame([(2, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int"))
    clean, score = toxicity.clean_documents(texts(spark, rows), held), [r.score for r in toxicity.toxicity(texts(spark, rows), held).collect()]
    assert clean.columns == single.columns and clean.count() == sum(x < toxicity.THRESHOLD for x in score) and len(score) == len(rows)
    assert toxicity.clean_documents(none, held).count() == p.redact_secrets(spark, none, None).count() == 0
    assert p.one_of_each_group(spark, none, None).count() == p.mix_sources(spark, none, None).count() == p.pack_windows(spark, none, None).count() == 0


def test_mix_of_shared_ids(spark):
    """Each text under one id or none is taken for itself; rows alike in all count together."""
    rows = [(1, "a b c d", "s", 9), (1, "e f", "s", 9), (None, "g h i", "s", 9), (None, "j", "s", 9), (2, "k l", "s", 9), (2, "k l", "s", 9), (2, "k l", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position int")
    got = mixing.mixed_documents(spark, docs)
    assert got.columns == docs.columns
    found = {}
    for r in got.collect():
        found.setdefault((r.doc_id, r.source), []).append(r.text)
    want = {}
    for r in mixing.curriculum(spark, docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert {i: sum(len(t.split()) for (d, _), own in found.items() if d == i for t in own) for i in want} == want
    whole = {t for _, t, _, _ in rows}
    assert all(any(t == w or w.startswith(t + " ") for w in whole) for own in found.values() for t in own)


def test_each_pass_has_its_own_position(spark):
    """Three sources of one size under 5:2:1 weights: in every tenth of the mix each source's words follow its schedule,
    second passes too, and the order of the rows is that of the passes' positions."""
    docs = spark.createDataFrame([(i, f"w{i} " * 4, "abc"[i % 3], 9) for i in range(1200)], "doc_id long, text string, source string, position int")
    mix = {r.source_size: r for r in mixing._mix(spark, docs).collect()}
    assert list(mix) == [1600]
    rows = [r.source for r in mixing.mixed_documents(spark, docs).collect()]
    target = {s: r.target for s, r in zip("abc", mixing.source_targets(docs.select(mixing.source_key().alias("key"), "source", F.lit(4).alias("size")), mixing.WEIGHTS, 1.5, 2).orderBy("key").collect(), strict=True)}
    assert target["a"] == 3200 and max(rows.count(s) * 4 - target[s] for s in "abc") <= 4
    done, whole = dict.fromkeys("abc", 0), {s: rows.count(s) for s in "abc"}
    by = {s: mixing.SCHEDULES[k] for k, s in enumerate("abc")}

    def integral(schedule, t):
        out = 0.0
        for (t0, v0), (t1, v1) in zip(schedule, schedule[1:], strict=False):
            if t > t0:
                e = min(t, t1)
                out += (v0 + v0 + (v1 - v0) * (e - t0) / (t1 - t0)) / 2 * (e - t0)
        return out

    def time_of(k):  # at which all sources together have given k rows
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(whole[s] * integral(by[s], mid) for s in "abc") < k else (lo, mid)
        return lo

    for k, s in enumerate(rows, 1):
        done[s] += 1
        if k % (len(rows) // 10) == 0:
            for x in "abc":
                assert abs(done[x] - whole[x] * integral(by[x], time_of(k))) <= 3


def test_lm_over_many_chunks_and_parts(spark, data, agree, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 40_000)
    monkeypatch.setattr(lm, "PART", 60_000)
    monkeypatch.setattr(lm, "BLOCK", 10_000)
    agree(QUERIES["op4_lm"](spark, data), ORACLES["op4_lm"])


def test_lm_copies_and_a_very_long_text(spark, monkeypatch):
    """Copies of one row go to different chunks and vouch for each other; scores don't depend on the chunks."""
    rows = [(7, "the same text again and again")] * 3000 + [(8, "word and word " * 20_000), (None, "nobody says xyzzy"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def scored():
        return sorted((r.doc_id or 0, r.n_words, r.log_score) for r in lm.lm_scores(spark, docs).collect())

    want = scored()
    for name, n in (("CHUNK", 5000), ("PART", 20_000), ("BLOCK", 500)):
        monkeypatch.setattr(lm, name, n)
    assert scored() == want and len(want) == 3003
    assert {r[2] for r in want if r[0] == 7} == {next(r[2] for r in want if r[0] == 7)}


def test_pii_in_a_dense_text_and_context(spark):
    n = 12_000
    dense = " ".join(f"a{i}@b{i}.com" for i in range(n))
    rows = [(1, dense), (2, "call +49 30 1234567"), (3, "hotel +49 30 1234567"), (4, "x 1.2.3.4 host"), (5, "1.2.3.4 then 5.6.7.8 server")]
    got = {r.doc_id: r.spans for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.start, s.end) for s in got[1]] == [m.span() for m in re.finditer(r"a\d+@b\d+\.com", dense)]
    assert {i: [s.score for s in got[i]] for i in (2, 3, 4, 5)} == {2: [0.8], 3: [0.6], 4: [0.7], 5: [0.5, 0.7]}


def plain_hashes(text, orders, bits):
    """The n-gram hashes of the toxicity features, one by one."""
    raw, out = [{**{k: 32 for k in range(9, 14)}, **{k: k + 32 for k in range(65, 91)}}.get(ord(c), ord(c)) for c in f" {text} "], []
    for n in orders:
        for i in range(len(raw) - n + 1):
            h = raw[i] + 1
            for c in raw[i + 1 : i + n]:
                h = (h * 0x01000193 + c) % 2**32
            x = (h * 0x9E3779B1 + n) % 2**32
            x ^= x >> 15
            out.append(((x * 0x85EBCA77) % 2**32) >> (32 - bits))
    return out


def test_toxicity_brute(spark, data):
    """The query against a plain choice of the sample and a plain scorer over each text's own n-grams."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id in text and r.doc_id not in held and text[r.doc_id] is not None and len(text[r.doc_id]) <= toxicity.LONGEST}
    ids = sorted(sorted(y, key=lambda i: (order[i], i))[: toxicity.SAMPLE])
    weights, bias = toxicity.fit_calibrated([text[i].encode() for i in ids], np.array([y[i] for i in ids], float))
    for r in QUERIES["op2_toxicity"](spark, data).collect():
        count, z = {}, bias
        for h in plain_hashes(text[r.doc_id] or "", toxicity.ORDERS, toxicity.BITS):
            count[h] = count.get(h, 0) + 1
            if count[h] <= toxicity.TIERS:
                z += float(weights[h + ((count[h] - 1) << toxicity.BITS)])
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6 and r.held_out == (r.doc_id in held) and r.predicted == int(r.score >= 0.3)


def test_toxicity_sample_is_of_documents_there(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5000)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4000, 4100)] + [(4000, "t")] * 3 + [(4500, None)], "doc_id long, text string")
    got = toxicity.sample(docs, labels, limit=80).collect()
    assert len({r.doc_id for r in got}) == len(got) == 80


def test_langid_brute(spark, data):
    """The query against a plain choice of the sample and one-by-one predictions."""
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("h", F.xxhash64("doc_id")).collect()
    held, own = {d.doc_id for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 == 1}, {}
    for d in sorted(docs, key=lambda d: (d.h, d.doc_id)):
        if d.doc_id not in held and d.lang and d.text and len(d.text) <= langid.LONGEST and any(c.isalpha() for c in d.text):
            own.setdefault(d.lang, []).append(d)
    rows = sorted((g, d.doc_id, d.text) for g, some in own.items() for d in some[: langid.SAMPLE])
    plain = langid.Hierarchy([r[2] for r in rows], [r[0] for r in rows])
    text = {d.doc_id: d.text or "" for d in docs}
    for r in QUERIES["op7_langid"](spark, data).collect():
        names, score = plain.predict([text[r.doc_id]])
        letters = any(c.isalpha() for c in text[r.doc_id])
        assert r.lang_pred == (names[0] if letters else "und") and abs(r.score - (score[0] if letters else 0)) < 1e-6 and r.held_out == (r.doc_id in held)


def test_langid_sample_is_bounded(spark, monkeypatch):
    rows = [(1, f"un texte {i} ou deux", "fr") for i in range(2000)] + [(1, "un texte", "fr")] * 500 + [(i, f"some words {i}", "en") for i in range(2, 900)] + [(5, "autre", "fr")]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((g, len([r for r in got if r.lang == g])) for g in ("en", "fr")) == [("en", 300), ("fr", 2)]
    monkeypatch.setattr(langid, "MOST", 40)
    assert langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == 40


def test_secrets_query_brute(spark, data):
    """Counts, hash and spans of the query against regular expressions over whole texts."""
    every = {k: (re.compile(p, (re.I if either else 0) | re.A), (lambda m: len(m[2]) >= 6) if k == "assign" else (lambda m, n=secrets.LEAST.get(k, 0): len(m[0]) >= n)) for k, (p, either) in secrets.RULES.items()}
    every["assign"] = BASE["assign"]
    every["pem"] = (re.compile(secrets.RULES["pem"][0] + secrets.KEY.pattern.decode()), lambda m: True)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    joined = lambda own: ",".join(f"{k}:{s}:{e}" for s, k, e in own)
    for r in QUERIES["op5_secrets"](spark, data).collect():
        base = spans(BASE, text[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == b for _, k, _ in base) for b in BASE)
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert r.spans == joined(spans(every, text[r.doc_id]))


def test_private_keys_whole(spark):
    body = "\n".join(["MIIEpAIBAAKCAQEA7bq0x" * 3] * 4)
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{body}\nabc=\n-----END RSA PRIVATE KEY-----"
    rows = [(1, f"é {key}\nmore text"), (2, key.replace("\n", "\r\n") + key), (3, "-----BEGIN PRIVATE KEY-----\nand words"), (4, f"-----BEGIN PRIVATE KEY-----\n{body}")]
    got = {r.doc_id: r.text for r in secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "é [SECRET]\nmore text", 2: "[SECRET][SECRET]", 3: "[SECRET]\nand words", 4: "[SECRET]"}


def test_fingerprints_brute(spark, data):
    import xxhash

    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in QUERIES["op8_simhash"](spark, data).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text[r.doc_id]))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        assert int(r.fingerprint, 16) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h) and h)


def brute_nearest(ids, x, every=50, top=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = u @ u[i]
        s[ids == ids[i]] = -9
        out[int(ids[i])] = [(int(ids[k]), s[k]) for k in np.lexsort((ids, -s))[:top]]
    return out


def test_ann_in_parts_and_blocks(spark, monkeypatch):
    """Learned parts, several blocks of a part and several turns of its queries, against brute force."""
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((60, 24))[rng.integers(0, 60, 6000)] + 0.5 * rng.standard_normal((6000, 24))).astype(np.float32)
    ids = np.arange(6000) * 7 % 6007
    for name, n in (("BLOCK", 150), ("QUERIES", 10)):
        monkeypatch.setattr(ann, name, n)
    got = {}
    for r in ann.search(spark, vectors(spark, x, ids)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want, hits = brute_nearest(ids, x.astype(float)), []
    assert set(got) == set(want)
    for q, near in want.items():
        own = [got[q][k] for k in range(1, 6)]
        assert own == sorted(own, key=lambda p: (-p[1], p[0])) and len({v for v, _ in own}) == 5
        score = dict(near)
        assert all(abs(s - score[v]) < 1e-12 for v, s in own if v in score)
        hits.append(len({v for v, _ in own} & set(score)))
    assert ann.fit(ann.unit(x.astype(float)), 6000).parts > 8 and np.mean(hits) >= 4.5


def test_ann_tree_of_parts(spark, monkeypatch):
    """Parts that are cut again: both ways of routing agree, and a query is compared with a small share of all vectors."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((150, 24))[rng.integers(0, 150, 6000)] + 0.4 * rng.standard_normal((6000, 24))
    ids, want, found = np.arange(6000), brute_nearest(np.arange(6000), x), []
    for name, n in (("SAMPLE", 1500), ("MOST_PARTS", 4), ("PER_PART", 100), ("LEAF", 400), ("BLOCK", 500)):
        monkeypatch.setattr(ann, name, n)
    table = vectors(spark, x, ids)
    for held, many in ((64 << 20, 50_000), (0, 0)):
        monkeypatch.setattr(ann, "HELD_BYTES", held)
        monkeypatch.setattr(ann, "MANY_PARTS", many)
        found.append(sorted(map(tuple, ann.search(spark, table).collect())))
    assert found[0] == found[1]
    assert len(found[0]) == 5 * len(want)
    assert np.mean([v in {k for k, _ in want[q]} for q, _, v, _ in found[0]]) >= 0.9
    homes, asked = ann.cut(spark, common.Scratch(spark), table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("vec_id").alias("qkey")))
    size = {r.part: r["count"] for r in homes.groupBy("part").count().collect()}
    assert sum(size.values()) == 6000 and len(size) > 8 and max(size.values()) <= 400
    visits = [r.part for r in asked.select("part").collect()]
    assert sum(size.get(p, 0) for p in visits) < 0.4 * 6000 * len(want)


@pytest.mark.parametrize("kind", ["orthogonal", "scaled", "binary"])
def test_ann_ties_of_all_kinds(spark, kind):
    n = 60
    x = {"orthogonal": np.eye(64)[: n + 1], "scaled": np.array([[1.0, 0.0]] + [[2.0**k, 2.0**k] for k in range(1, n + 1)]), "binary": np.array([[1, 1, 0, 0]] + [[1, 0, 1, 0], [0, 1, 0, 1]] * (n // 2), float)}[kind]
    got = {r["rank"]: r.vec_id for r in ann.search(spark, vectors(spark, x[np.r_[0, n:0:-1]], np.r_[0, n:0:-1])).collect() if r.query_id == 0}
    assert got == {k: k for k in range(1, 6)}


def test_labels_of_frequent_and_rare_values(spark, monkeypatch):
    """Every row meets its value's label once, whether the value is broadcast or shuffled; at most HOT are broadcast."""
    values = [0] * 300 + [1] * 40 + [k for k in range(2, 62) for _ in range(2)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    labels = rows.groupBy("v").agg((F.col("v") * 10).alias("label"), F.count("*").alias("n"))
    for most in (1, 5, 1000):
        monkeypatch.setattr(common, "HOT", most)
        got = common.with_labels(rows, labels, "v")
        assert got.columns == ["v", "id", "label"]
        assert sorted((r.id, r.label) for r in got.collect()) == [(i, v * 10) for i, v in enumerate(values)]
        assert labels.where(F.col("n") * most >= len(values)).count() == {1: 0, 5: 1, 1000: 62}[most]
    assert common.with_labels(rows.limit(0), labels.limit(0), "v").count() == 0


@pytest.mark.parametrize("most", [1, 8])
def test_groups_whatever_is_frequent(spark, data, monkeypatch, most):
    want = [sorted(map(tuple, QUERIES[q](spark, data).collect())) for q in ("op3_neardup", "op8_simhash")]
    monkeypatch.setattr(common, "HOT", most)
    assert [sorted(map(tuple, QUERIES[q](spark, data).collect())) for q in ("op3_neardup", "op8_simhash")] == want
