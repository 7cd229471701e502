"""Operators and the pipeline against plain versions that compare everything with everything, in Python alone."""

import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import language, mixing, packing, quality, queries, toxicity
from linkloom.llm.common import fold

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.read.parquet(f"{TINY}/documents.parquet")


# --- toxicity


def plain_words(text):
    return "".join(c if c >= "\x80" or "a" <= c <= "z" else " " for c in (text or "").lower()).split(" ") if text else []


def plain_tokens(text):
    return [w for w in plain_words(text) if w]


def plain_model(rows, counted):
    """rows: texts that may be learned from; counted: (label, text) of class counts. Word to difference and strength, and that of unknown words."""
    documents = Counter(w for t in rows for w in set(plain_tokens(t)))
    contexts = [defaultdict(set), defaultdict(set)]
    for y, t in counted:
        w = plain_tokens(t)
        for before, word in zip([None, *w], w, strict=False):
            contexts[y][word].add(before)
    k = [{w: len(c) for w, c in contexts[y].items()} for y in (0, 1)]
    total, n = [sum(k[y].values()) for y in (0, 1)], sum(documents.values())
    ones, twos = ([sum(c == m for c in k[y].values()) for y in (0, 1)] for m in (1, 2))
    d = [min(0.95, max(0.05, ones[y] / (ones[y] + 2 * twos[y]))) if ones[y] else 0.5 for y in (0, 1)]
    free = [d[y] * len(k[y]) / total[y] if total[y] else 1.0 for y in (0, 1)]
    p = lambda y, w: max(k[y].get(w, 0) - d[y], 0) / max(1, total[y]) + free[y] * documents[w] / n
    out = {}
    for w in set(k[0]) | set(k[1]):
        diff = math.log(p(1, w)) - math.log(p(0, w))
        seen = k[1 if diff > 0 else 0].get(w, 0)
        out[w] = diff, math.copysign(max(abs(diff) - toxicity.ERRORS / math.sqrt(max(seen, 1)), 0), diff)
    for y in (0, 1):  # all that a class gives adds up to one
        assert not total[y] or sum(p(y, w) for w in documents) == pytest.approx(1)
    return out, math.log(free[1]) - math.log(free[0])


def plain_evidence(text, model, unknown):
    w = plain_tokens(text)
    n = max(1, len(w))
    strong = [model[x][1] if x in model else 0 for x in w]
    return sum(model[x][0] if x in model else unknown for x in w) / n, sum(max(s - toxicity.TAIL, 0) for s in strong) / n, sum(max(-s - toxicity.TAIL, 0) for s in strong) / n, len(w)


@pytest.mark.parametrize("broadcast", [10**6, 40])
def test_toxicity_against_plain_counts(spark, docs, sf, monkeypatch, broadcast):
    monkeypatch.setattr(toxicity, "MODEL_WORDS", broadcast)
    rows = docs.where("doc_id < 300").select("doc_id", F.when(F.col("doc_id") != 7, F.col("text")).alias("text")).collect()
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(3, "idiot idiot one"), (None, "no id"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    learn = fold(F.col("doc_id"), 3) != 1
    held = {r["doc_id"]: r["f"] == 1 for r in df.select("doc_id", fold(F.col("doc_id"), 3).alias("f")).collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] in (0, 1)}
    known = {i: y for i, y in known.items() if held.get(i) is False or i not in held}
    every = labels.where(learn & F.col("toxic").isin(0, 1)).select("doc_id", "toxic", toxicity.share(F.col("doc_id"), 23).alias("s")).collect()
    sizes = Counter(r["toxic"] for r in every)
    curve = {r["doc_id"] for r in every if r["s"] < min(1 / toxicity.CURVE, toxicity.PER_CLASS / sizes[r["toxic"]])}
    may = [(i, t) for i, t in rows if i is not None and not held[i]]
    model, unknown = plain_model([t for _, t in may], [(known[i], t) for i, t in may if i in known and i not in curve])
    made = toxicity.learn(df, labels, learn)
    assert (made.rest is not None) == (broadcast < len(model)) and len(made.word) <= broadcast
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["mean"], r["above"], r["below"], r["n_words"], r["score"]) for r in toxicity.score(df, made).collect())
    c = made.curve

    def score(m, a, b, n):
        return 1 / (1 + math.exp(-min(500, max(-500, c[0] + c[1] * m + c[2] * b + c[3] * a * math.sqrt(n) + c[4] * math.log1p(a * n)))))

    want = sorted((-1 if i is None else i, *e, score(*e)) for i, t in rows for e in [plain_evidence(t, model, unknown)])
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose(np.array([g[1:] for g in got]), np.array([w[1:] for w in want]), atol=2e-5)


# --- language


def plain_profile(text):
    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    if not spaced.strip():
        return None
    line = " " + " ".join(spaced.split(" ")) + " "
    while "  " in line:
        line = line.replace("  ", " ")
    return Counter(g for n in (1, 2, 3) for i in range(len(line) - n + 1) for g in [line[i : i + n]] if g != " " and not (n == 3 and g[1] == " "))


def order(counts, size):
    number = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))][:size]


def test_language_against_plain_ranks(spark, tiny, monkeypatch):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in tiny.collect()] + [(None, None, "en"), (900, "123", "en"), (901, "x", None), (902, "qqq", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r["doc_id"]: r["f"] == 2 for r in df.select("doc_id", fold(F.col("doc_id"), 4).alias("f")).collect()}
    total = defaultdict(Counter)
    for i, t, lang in rows:
        if i is not None and not held[i] and lang is not None and (p := plain_profile(t)):
            total[lang] += p
    known = {lang: {g: n for n, g in enumerate(order(c, 300))} for lang, c in sorted(total.items())}

    def plain(text):
        p = plain_profile(text) if text else None
        if not p:
            return "und", 0.0
        own = order(p, 300)
        far = sorted((sum(min(abs(k[g] - n), 300) if g in k else 300 for n, g in enumerate(own)) / (300 * len(own)), lang) for lang, k in known.items())
        return far[0][1], far[1][0] / (far[0][0] + far[1][0])

    want = sorted((-1 if i is None else i, *plain(t)) for i, t, _ in rows)
    for block in (language.LANGUAGES, 1):
        monkeypatch.setattr(language, "LANGUAGES", block)
        profiles = language.learn(df, fold(F.col("doc_id"), 4) != 2)
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(df, profiles).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


# --- quality


def test_quality_against_all_pairs_of_features(spark, tiny):
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    machine = quality.learn(tiny, labels, fold(F.col("doc_id"), 5) != 0)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score(tiny, machine).collect()}
    for r in tiny.limit(25).collect():
        words = Counter(w.translate(UPPER) for w in r["text"].split())
        at, x = quality.features(r["text"].encode(), quality._ids())
        assert len(at) == len(words) + len(quality.STATISTICS) and (x[: len(words)] ** 2).sum() == pytest.approx(1)
        keep = list(range(min(len(at), 120)))  # of long texts the first features, by the same formula
        pairs = sum(float(machine.v[at[i]] @ machine.v[at[j]]) * x[i] * x[j] for i in keep for j in keep if i < j)
        plain = machine.bias + sum(float(machine.w[at[i]]) * x[i] for i in keep) + pairs
        assert machine.raw([at[keep]], [x[keep]])[0] == pytest.approx(plain, abs=1e-5)
        if len(keep) == len(at):
            p = 1 / (1 + math.exp(-plain))
            assert got[r["doc_id"]][0] == pytest.approx(p, abs=1e-5) and got[r["doc_id"]][1] == (p >= 0.3)


# --- the pipeline


def plain_near(rows):
    """Smallest id of each group of texts whose five-word shingle sets have a similarity of 0.8, by all pairs."""
    sets = []
    for _, t, _ in rows:
        w = [x for x in t.translate(UPPER).replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        before = list(group)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                    group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    best = {}
    for i, (d, _, _) in enumerate(rows):
        best[group[i]] = min(best.get(group[i], d), d)
    return [r for r in rows if r[0] in best.values()]


def plain_mix(rows, order_of, block):
    """Slot by slot: of the blocks that are released the one that is due first, until a source runs out; then on with the others."""
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: order_of[r[0]]):
        by[r[2]].append(r)
    blocks = {s: [x[i : i + block] for i in range(0, len(x), block)] for s, x in by.items()}
    weight = {s: Fraction(len(x) ** mixing.POWER) for s, x in by.items()}
    out, done = [], dict.fromkeys(blocks, 0)
    while left := {s for s in blocks if done[s] < len(blocks[s])}:
        total, begun, slot = sum(weight[s] for s in left), {s: done[s] for s in left}, 0
        while True:
            share = {s: weight[s] / total for s in left}
            nth = {s: done[s] - begun[s] for s in left}
            ready = [(math.ceil((nth[s] + 1) / share[s]), f"={s}", s) for s in left if math.floor(nth[s] / share[s]) <= slot]
            _, _, s = min(ready)
            if done[s] == len(blocks[s]):
                break
            out.append(blocks[s][done[s]])
            done[s] += 1
            slot += 1
    return [(i * block + j, r) for i, b in enumerate(out) for j, r in enumerate(b)]


def plain_pack(positions, window):
    """By window of positions: full pieces alone, the rest best-fit by trying all bins, for each largest length to open."""
    costs, top = packing.COSTS, max(packing.COSTS)
    windows = defaultdict(list)
    for at, (d, t, _) in positions:
        n = len(t.split()) + 1
        windows[at // window] += [(at, d, p, min(top, n - p * top)) for p in range(-(-n // top))]
    out = []
    for w, pieces in windows.items():
        rest = sorted((x for x in pieces if x[3] < top), key=lambda x: -x[3])
        best = None
        for most in sorted(costs):
            bins, left = [], sum(x[3] for x in rest)  # free room, when last put, contents
            for clock, x in enumerate(rest):
                fits = [b for b in bins if b[0] >= x[3]]
                if fits:
                    b = min(fits, key=lambda b: (b[0], -b[1]))
                else:
                    able = [c for c in sorted(costs) if c >= x[3]]
                    c = min([c for c in able if c <= most] or able[:1], key=lambda c: (costs[c] / min(c, left), c))
                    bins.append(b := [c, 0, []])
                b[0], b[1], left = b[0] - x[3], clock, left - x[3]
                b[2].append(x)
            final = [min(c for c in costs if c >= sum(x[3] for x in b[2])) for b in bins]
            if best is None or sum(costs[c] for c in final) < best[0]:
                best = sum(costs[c] for c in final), [(c, b[2]) for c, b in zip(final, bins, strict=True)]
        bins = best[1] + [(top, [x]) for x in pieces if x[3] == top]
        for nth, (c, own) in enumerate(sorted(bins, key=lambda b: min((x[0], x[2]) for x in b[1]))):
            start = 0
            for at, d, p, n in sorted(own, key=lambda x: (x[0], x[2])):
                out.append((d, p, p * top, n, c, start, w, nth, at))
                start += n
    return sorted(out)


def test_pipeline_against_plain_stages(spark, sf, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    monkeypatch.setattr(packing.pack_in_order, "__defaults__", (None, 64))
    part = docs.where("doc_id < 350")
    part.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.learn(part, labels, fold(F.col("doc_id"), 3) != 1)  # held against plain counts above
    toxic = {r["doc_id"] for r in toxicity.score(part, model).where("score >= 0.7").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in part.collect() if r["doc_id"] not in toxic]
    kept = {}
    for r in rows:
        kept[r[1].translate(UPPER)] = max(kept.get(r[1].translate(UPPER), r), r, key=lambda x: x[0])
    near = plain_near(sorted(kept.values()))
    hashed = {r["doc_id"]: r["h"] for r in part.select("doc_id", F.xxhash64(F.lit(5), "doc_id").alias("h")).collect()}
    buckets = {s: -(-n // mixing.BUCKET_ROWS) for s, n in Counter(r[2] for r in near).items()}
    assert set(buckets.values()) == {1}  # so rows of a source come by hash alone
    want = plain_pack(plain_mix(near, hashed, 4), 64)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    columns = ("doc_id", "piece", "piece_start", "length", "capacity", "start", "window", "nth", "position")
    assert toxic and len(near) < len(kept) < len(rows)
    assert sorted(tuple(r[c] for c in columns) for r in got) == want


def test_queries_read_whole_tables(spark, tiny):
    ids = sorted(r["doc_id"] for r in tiny.select("doc_id").collect())
    for name in ("op3_source_mixing", "op4_toxicity", "op6_language_id", "op10_quality"):
        assert sorted(r["doc_id"] for r in queries.QUERIES[name](spark, TINY).select("doc_id").collect()) == ids
