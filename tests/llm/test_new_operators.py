"""Fill-in-middle, centroid clustering, line dedup: against plain versions and on odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from molspark.llm import clusters, fim, linededup

from test_operators import ODD, texts

MARKS = "<P>", "<S>", "<M>"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text, units):
    text = text or ""
    s = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = units(text)
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, None, text
    p, m, x = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (len(u), "spm", p, m, x, f"<S>{x}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(u), "psm", p, m, x, f"<P>{p}<S>{x}<M>{m}")


@pytest.mark.parametrize("units", ["code points", "words", "lines"])
def test_fim_brute(spark, units):
    import re

    cut = {"code points": list, "words": lambda t: re.findall(r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*|[ \t\n\v\f\r]+", t), "lines": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)}[units]
    rng = random.Random(1)
    signs = ["\x01", "\x02", "\x02a", "\x02b", "a", "b", " ", "\n", "é", "日", "😀", "<", "S>", "<P", "$1", "\\", "\x00", "\r"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(12)))) for i in range(300)]
    if units != "code points":  # an escaped sign is a unit of its own elsewhere
        rows = [(i, t.replace("\x01", "").replace("\x02", "")) for i, t in rows]
    rows += [(r[0], r[1]) for r in ODD] + [(400, "<P>x"), (401, "a<M>b"), (402, "😀" * 70_000), (402, "😀" * 70_000), (None, None)]
    got = fim.fill_in_middle(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, form string"), units)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *plain_fim(i, t, cut))) for i, t in rows)
    back = got.select("doc_id", "output", fim.restored(got["output"], got["form"]).alias("text")).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in rows)
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * x) if abs(x) < 1e15 else 64 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    at = [v for _, v in sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in at]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[0]].append(v)
        at = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(at)]
    return sorted((str(i), j, min(d, 2**63 - 1)) for i, v in kept for j, d in [near(v)]), at


def check_clusters(spark, rows, k=5, rounds=4, dim=3, kind="double"):
    table = spark.createDataFrame([(i, v, 7) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int")
    got, at = clusters.cluster(spark, table, k, rounds, dim)
    want, centers = plain_clusters(rows, k, rounds, dim)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want and at == centers


def test_clusters_brute(spark):
    rng = np.random.default_rng(2)
    spread = rng.normal(size=(6, 3)) * 20
    rows = [(i, (spread[i % 6] + rng.normal(size=3)).tolist()) for i in range(300)]
    check_clusters(spark, rows)
    check_clusters(spark, [(i, rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(200)], kind="float")  # ties


def test_clusters_odd_rows(spark):
    odd = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, [1.0, 2.0, 3.0, 4.0])]
    fine = [(8, [0.0, 0.0, 0.0]), (8, [0.0, 0.0, 0.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 0.0, -1.0]), (9, [-0.001, 0.5, 2.0])]
    check_clusters(spark, odd + fine)
    check_clusters(spark, fine, k=50)
    check_clusters(spark, fine + [(20 + i, [1e30 * i, -1e18, 3.0]) for i in range(5)] + [(40, [1e300, 1.0, 1.0])], k=3)
    none = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got, at = clusters.cluster(spark, none, dim=3)
    assert got.count() == 0 and at == []


def test_clusters_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert clusters.op12_clusters(spark, str(tmp_path)).collect() == []


def test_exponion_scans_less_and_finds_the_same():
    rng = np.random.default_rng(3)
    homes = rng.normal(size=(60, 4)) * 30
    x = clusters.whole(np.concatenate([homes + rng.normal(size=(60, 4)) for _ in range(50)]))
    at = clusters.whole(homes).tolist()
    near, _, upper, lower = clusters.Centroids(at).scan(x)
    for _ in range(3):
        before, at = at, [x[near == a].mean(axis=0).astype(int).tolist() if (near == a).any() else at[a] for a in range(60)]
        now = clusters.Centroids(at, before)
        near, upper, lower, made = now.search(x, near, upper, lower)
        assert (near == now.scan(x)[0]).all() and made < len(x) * 60 / 10


WS = "\x20\t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows, least, chars=1):
    key = lambda line: line.strip(WS).translate(LOW)
    count = Counter(k for _, t in {(i, t) for i, t in rows} for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= chars and count[key(x)] >= least)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def check_lines(spark, rows, least, chars=1, parts=None):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pos string, h1 int")
    got = linededup.line_dedup(docs.repartition(parts) if parts else docs, least, chars)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got.collect()) == plain_lines(rows, least, chars)


@pytest.mark.parametrize("least,chars", [(1, 1), (2, 1), (10, 1), (3, 4)])
def test_lines_brute(spark, least, chars):
    rng = random.Random(least)
    lines = ["", " ", "Ab", "aB\t", "É", "é", "hot line", " HOT LINE\r", "\x1chot", "日本語"] + [f"line {i}" for i in range(60)]
    rows = [(i, "\n".join(["hot line"] * rng.randrange(4) + [rng.choice(lines) for _ in range(rng.randrange(15))])) for i in range(150)]
    check_lines(spark, rows, least, chars, parts=5)


def test_lines_odd_rows(spark):
    rows = [(r[0], r[1]) for r in ODD] + [(50, "a\n" * 3000 + "b"), (51, "A\nc"), (None, "a"), (None, "b\n"), (None, None), (52, "\n\n\n")]
    check_lines(spark, rows + rows[:3], 2)
    check_lines(spark, rows, 3)
    assert linededup.line_dedup(texts(spark, [])).count() == 0


def test_runs_over_batches_and_partitions():
    """The stream over every way to cut sorted rows into partitions and batches decides alike, once ends are added up."""
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted({(h, h + 1, d, 0, p) for h in (1, 2, 3, 4) for d in range(rng.choice([1, 2, 3, 9])) for p in range(rng.choice([1, 3]))})
    docs = {h: len({r[2] for r in rows if r[0] == h}) for h in (1, 2, 3, 4)}
    for trial in range(60):
        least, ends, gone, open_ = rng.choice([1, 2, 3, 9]), [], set(), []
        cuts = sorted(rng.sample(range(len(rows)), rng.randrange(5)))
        for s, e in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            part, size = rows[s:e], rng.randrange(1, 6)
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 4 else pa.int64()) for k, c in enumerate(zip(*part[i : i + size], strict=True))], names=linededup.KEY) for i in range(0, len(part), size)]
            for b in linededup._stream(least)(iter(batches)):
                for r in b.to_pylist():
                    line = tuple(r[c] for c in linededup.KEY)
                    if r["kind"] == linededup.END:
                        ends.append((line, r["n"], (r["last_doc"], r["last_key"])))
                    elif r["kind"] == linededup.DROP:
                        gone.add(line)
                    else:
                        open_.append(line)
        total, last = Counter(), {}
        for line, n, end in sorted(ends):
            total[line[0]] += n - (last.get(line[0]) == line[2:4])
            last[line[0]] = end
        gone |= {x for x in open_ if total[x[0]] >= least}
        assert gone == {r for r in rows if docs[r[0]] >= least}, trial


def test_one_document_in_all_rows(spark):
    """A third of all rows alike in id and text are one document: its lines reach the sort once a task."""
    rows = [(7, "same\nsame again")] * 400 + [(i, f"same\nown {i}") for i in range(100, 108)]
    check_lines(spark, rows, 9, parts=4)
    check_lines(spark, rows, 10, parts=4)


def largest_shuffle(spark, run):
    """The most rows that one task of ``run`` read from a shuffle, from the status store."""
    store = spark.sparkContext._jsc.sc().statusStore()
    before, coalesce = {s.stageId() for s in _stages(store)}, "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, False)  # else small tables meet in one task anyway
    run()
    spark.conf.unset(coalesce)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most = 0
    for s in _stages(store):
        if s.stageId() not in before and s.shuffleReadRecords():
            tasks = store.taskList(s.stageId(), s.attemptId(), 10_000)
            for i in range(tasks.size()):
                t = tasks.apply(i).taskMetrics()
                if t.isDefined():
                    m = t.get().shuffleReadMetrics()
                    most = max(most, m.recordsRead())
    return most


def _stages(store):
    seq = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [seq.apply(i) for i in range(seq.size())]


def test_mix_with_many_copies_of_a_row(spark, monkeypatch):
    """80 % of all rows are alike: the same rows as plain arithmetic, and no task of the mix gets all the copies."""
    from molspark.llm import mixing

    monkeypatch.setattr(mixing, "SLOT", 50)
    rows = [(7, "a b c", "s", 1)] * 4000 + [(i, "w " * (i % 5), "st"[i % 2], 1) for i in range(1000, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(8)
    out = []
    most = largest_shuffle(spark, lambda: out.extend(mixing.curriculum(spark, docs).collect()))
    sizes = {"s": sum(len(t.split()) for _, t, s, _ in rows if s == "s"), "t": sum(len(t.split()) for _, t, s, _ in rows if s == "t")}
    taken = Counter()
    for r in out:
        taken[r.source_size] += r.taken
    target = {r.source_size: r.target for r in out}
    assert len(out) == 5000 and set(target) == set(sizes.values()) and all(abs(taken[n] - target[n]) <= 1 for n in target)
    assert sum(r.doc_id == 7 for r in out) == 4000 and all(r.taken <= 2 * r.size for r in out)
    assert len({r.position for r in out if r.doc_id == 7 and r.size}) > 3900  # each has a place of its own
    assert most < 2500
    got = [r.text for r in mixing.mixed_documents(spark, docs).collect()]
    assert sum(len(t.split()) for t in got) == sum(taken.values())
    assert sum(len(t.split()) for t in got if t.startswith("a")) == sum(r.taken for r in out if r.doc_id == 7)


def test_search_with_a_common_vector(spark):
    """80 % of all rows have one vector: plain results, and the copies are thinned out before they meet."""
    from molspark.llm import ann

    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(4000)] + [(9000, [3.0, 1.0, 2.0])] * 500 + [(i, rng.normal(size=3).tolist()) for i in range(4000, 5000)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, n int").repartition(8)
    valid = table.select("vec_id", "embedding")
    out = []
    most = largest_shuffle(spark, lambda: out.extend(ann.search(spark, valid).collect()))
    for r in out:
        if r.query_id < 4000:
            want = [i for i in range(7) if i != r.query_id][r["rank"] - 1]
            assert r.vec_id == want and abs(r.score - 1) < 1e-12
    assert len(out) == 5 * (sum(i % 50 == 0 for i, _ in rows)) and most < 2500


def test_parts_of_hashes():
    """Cuts by part equal a plain loop; a chunk's cost doesn't grow with the number of parts."""
    import time

    from molspark.llm import lm

    own = np.unique(np.random.default_rng(6).integers(0, 2**64, 5000, dtype=np.uint64))
    for parts in (1, 3, 1000):
        got = lm.parted(own, parts)
        assert [x for p, a, b in got for x in [p] * (b - a)] == [((int(h) >> 32) * parts) >> 32 for h in own]
        assert got[0][1] == 0 and got[-1][2] == len(own) and len({p for p, _, _ in got}) == len(got)
    start = time.perf_counter()
    assert len(lm.parted(own, 6_250_000)) <= len(own) and time.perf_counter() - start < 0.5
    assert lm.parted(own[:0], 4) == []


def test_toxicity_fit_is_the_optimum():
    """Log-count ratios by hand; at the fitted weights the penalized loss is what plain Newton steps over all features reach."""
    from molspark.llm import toxicity

    rng = random.Random(7)
    texts = [" ".join(rng.choice(["vile", "awful", "nice", "calm", "tree", "house", "river"][(2 if k % 3 else 0) :]) for _ in range(6)).encode() for k in range(90)]
    y = np.array([k % 3 == 0 for k in range(90)], float)
    weights, bias = toxicity.fit(texts, y, rounds=500)
    own = [toxicity.tiered(t) for t in texts]
    df, toxic = Counter(int(f) for x in own for f in x), Counter(int(f) for x, t in zip(own, y, strict=True) if t for f in x)
    kept = sorted(f for f, n in df.items() if n >= toxicity.LEAST_DOCS)
    p, q = sum(toxic[f] + 1 for f in kept), sum(df[f] - toxic[f] + 1 for f in kept)
    ratio = np.array([math.log((toxic[f] + 1) / p) - math.log((df[f] - toxic[f] + 1) / q) for f in kept])
    x = np.array([[f in held for f in kept] for held in map(set, own)], float) * ratio
    ridge = 3.0 / len(y) * (x * x).sum(axis=1).mean() * 1e-2
    z = np.column_stack([x, np.ones(len(y))])

    def loss(w):
        return np.logaddexp(0, -(2 * y - 1) * (z @ w)).mean() + ridge * (w[:-1] @ w[:-1])

    w = np.zeros(z.shape[1])
    for _ in range(30):
        s = 1 / (1 + np.exp(-z @ w))
        pull = np.append(2 * ridge * w[:-1], 0)
        w = w - np.linalg.solve((z * (s * (1 - s))[:, None]).T @ z / len(y) + np.diag(np.append(np.full(len(kept), 2 * ridge), 0)), z.T @ (s - y) / len(y) + pull)
    got = np.append(np.divide(weights[kept], ratio, out=np.zeros(len(kept)), where=ratio != 0), bias)
    assert not np.delete(weights, kept).any()
    assert loss(got) < loss(w) + 1e-4 and np.corrcoef(z @ got, z @ w)[0, 1] > 0.999


def test_language_machine_is_the_optimum():
    """The squared hinge machine against Newton steps on its active rows."""
    from molspark.llm import langid

    rng = np.random.default_rng(8)
    x = rng.standard_normal((120, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x @ rng.standard_normal(6) + 0.2 * rng.standard_normal(120) > 0.3, 1.0, -1.0)
    z, weight = np.column_stack([x, np.ones(120)]), np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(w):
        return 0.5e-3 * (w @ w) + weight @ np.maximum(0, 1 - y * (z @ w)) ** 2

    w = np.zeros(7)
    for _ in range(100):
        on = y * (z @ w) < 1
        w = 0.5 * w + 0.5 * np.linalg.solve(1e-3 * np.eye(7) + 2 * (z[on] * weight[on, None]).T @ z[on], 2 * z[on].T @ (weight * y)[on])
    assert abs(loss(langid.machine(x, y, rounds=3000)) - loss(w)) < 1e-6
    quick = langid.machine(x, y)
    assert loss(quick) < 1.05 * loss(w) and ((z @ quick > 0) == (z @ w > 0)).mean() > 0.97
