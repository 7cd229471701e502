import random

import numpy as np
import pytest
import xxhash
import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from linkloom.llm import simhash
from linkloom.llm.components import components


def plain(text, k=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, ids, radius):
    """Smallest id reachable, by comparing all pairs."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    x = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(fps))]


def test_fingerprint_is_the_plain_one():
    for t in ("", "  ", "One", "a b", "A b c d e f a b c", "É é\x0bß x y z", "x " * 500):
        assert simhash.fingerprint(t.encode())[0] == plain(t)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(str(i % 97) for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(text) == whole


def test_sketches_estimate_the_similarity(monkeypatch):
    rng = random.Random(7)
    words = [str(rng.randrange(10**6)) for _ in range(6000)]
    a, b = " ".join(words[:5000]).encode(), " ".join(words[1000:]).encode()
    made = [np.frombuffer(simhash.fingerprint(t, 5, 8)[2], np.uint8)[None] for t in (a, b)]
    assert abs(simhash.similarity(*made)[0] - 2 / 3) < 0.09
    sketch = simhash.fingerprint(a, 5, 8)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(a, 5, 8) == sketch


def test_query_against_all_pairs(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    fps = [plain(r["text"]) for r in rows]
    want = dict(zip([r["doc_id"] for r in rows], zip(fps, groups(fps, [r["doc_id"] for r in rows], 2), strict=True), strict=True))
    assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in got} == want


def test_links_lose_nothing_in_large_groups(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(3))) for b in base for _ in range(80)} | {rng.getrandbits(64) for _ in range(100)})
    monkeypatch.setattr(simhash, "BLOCK", 20)
    prints = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r["fp"] % (1 << 64): r["component_id"] for r in simhash.classes(prints).collect()}
    assert [got[f] for f in fps] == groups(fps, list(range(len(fps))), 2)


def test_pigeonring_never_drops_a_near_pair():
    rng = np.random.default_rng(1)
    for radius in (0, 1, 2, 3, 12):
        x = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 1), replace=False)) for _ in range(2000)], dtype=np.uint64)
        assert simhash.pigeonring(x, radius).all()
        y = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        assert (simhash.near(y, radius) == (np.bitwise_count(y) <= radius)).all()


def test_chain_keys_meet(spark):
    rng = random.Random(5)
    pairs = [(f, f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for f in (rng.getrandbits(63) for _ in range(300))]
    signed = [(a, b - (1 << 64) if b >> 63 else b) for a, b in pairs]
    found = spark.createDataFrame(signed, "a long, b long").select(F.arrays_overlap(simhash.chain_keys(F.col("a"), 2), simhash.chain_keys(F.col("b"), 2)).alias("m"))
    assert all(r["m"] for r in found.collect())


def test_sketch_against_all_pairs(spark, docs, monkeypatch):
    """Near copies of the pipeline's stage: all pairs of five-word fingerprints within 18 bits whose shingles have a Jaccard
    similarity of 0.8 or more meet, and no group holds a document that is not so similar to another of it."""
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs, 5, 18, 8).collect()}
    ids = sorted(rows)
    x = np.array([rows[i]["fp"] % (1 << 64) for i in ids], dtype=np.uint64)
    texts = {r["doc_id"]: r["text"].lower().split() for r in docs.select("doc_id", "text").collect()}
    shingles = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    found = missed = 0
    linked = set()
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 18) + i + 1:
            a, b = shingles[ids[i]], shingles[ids[int(j)]]
            if len(a & b) >= 0.8 * len(a | b):
                same = rows[ids[i]]["component_id"] == rows[ids[int(j)]]["component_id"]
                found, missed = found + same, missed + (not same)
                linked |= {ids[i], ids[int(j)]}
    assert found > 50 and missed <= 0.02 * found
    assert {i for i in ids if rows[i]["component_id"] != i} <= linked


def test_forest_and_doubtful_links_join_what_all_links_do_at_any_similarity_within_the_margin():
    rng = np.random.default_rng(11)
    base = rng.integers(1, 256, (3, simhash.BINS), dtype=np.uint8)
    s = base[rng.integers(0, 3, 90)]
    changed = rng.random(s.shape) < rng.uniform(0, 0.2, (90, 1))
    s[changed] = rng.integers(1, 256, int(changed.sum()), dtype=np.uint8)
    f, keys, nodes = np.arange(90, dtype=np.uint64), np.full(90, 7), np.arange(90)
    a, b, est = simhash._links_in(keys, nodes, f, s, 18, 0.8, (0, 90), None)
    assert (est != simhash.OPEN).all() and len(a) < 90 * 89 // 4
    assert (simhash._links_in(keys, nodes, f, s, 18, 0.8, (0, 2), None)[2] == simhash.OPEN).sum() == 1
    for least in (0.73, 0.77, 0.8, 0.84, 0.87):
        label = np.arange(90)
        want = np.arange(90)
        for _ in range(90):
            for i, j in zip(a[est >= least], b[est >= least], strict=True):
                label[[i, j]] = label[[i, j]].min()
            for i in range(90):
                want[i] = min(want[i], want[simhash.similarity(s, s[i]) >= least].min())
        assert (label == want).all()


def test_sets_of_the_similarity_share_a_key_of_the_prefix():
    rng = random.Random(23)
    for _ in range(3000):
        both, more_a, more_b = (rng.sample(range(10**6), rng.randrange(*r)) for r in ((1, 40), (0, 9), (0, 9)))
        a, b = sorted({*both, *more_a}), sorted({*both, *more_b})
        if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)):
            assert set(a[: simhash.prefix(len(a), 0.8)]) & set(b[: simhash.prefix(len(b), 0.8)])


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 11
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fp"] == by[2]["fp"] and by[2]["component_id"] == 1
    assert by[3]["fp"] == by[4]["fp"] == by[5]["fp"] == 0 and by[5]["component_id"] == 3
    assert sum(r["doc_id"] == 7 for r in got) == 2 and by[None]["component_id"] is None
    assert simhash.near_duplicates(no_docs).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 200 for i in range(201, 260)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_with_hubs_and_without_local_stars(spark, monkeypatch):
    from linkloom.llm import components as module

    rng = random.Random(29)
    edges = [(0, i) for i in range(1, 400)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(420)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(40)
    least = list(range(900))
    for _ in range(900):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    want = {i: r for i, r in enumerate(least) if r != i}
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    monkeypatch.setattr(module, "DEGREE", 3)
    monkeypatch.setattr(module, "stars", lambda a, b: (np.maximum(a, b), np.minimum(a, b)))
    assert {r["node"]: r["root"] for r in components(df).collect()} == want


def test_a_radius_without_chains_needs_a_sketch(spark):
    assert simhash.ring(2) == (5, 2) and simhash.ring(12) == (4, 0)
    with pytest.raises(ValueError):
        simhash.classes(spark.createDataFrame([(1, 2)], "doc_id long, fp long"), 12)


def test_equal_fingerprints_of_unlike_texts_stay_apart(spark):
    line = "this line is said over and over again in all of these texts "
    texts = [line * 50 + " ".join(f"own{i}x{k}" for k in range(60)) for i in range(6)] + [line * 40 + " ".join(f"own0x{k}" for k in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len({simhash.fingerprint(t.encode(), 5)[0] for t in texts}) < len(texts) - 1
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, 5, 18, 8).collect()}
    assert got == {i: i for i in range(6)} | {6: 0}


def test_repeats_of_lines_part_no_near_copies(spark):
    rng = random.Random(13)
    texts = []
    for i in range(20):
        own, line = (" ".join(f"w{rng.randrange(10**7)}" for _ in range(n)) for n in (150, 20))
        texts += [f"{own} " + f"{line} " * 2, f"{own} end " + f"{line} " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.near_duplicates(df, pipeline.SHINGLE, pipeline.RADIUS, pipeline.SKETCH, similar=pipeline.SIMILAR)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i - i % 2 for i in range(40)}


def test_stage_against_all_pairs_of_any_distance(spark, docs):
    """All pairs of 0.8 or more count, however many bits differ."""
    found = simhash.near_duplicates(docs, pipeline.SHINGLE, pipeline.RADIUS, pipeline.SKETCH, similar=pipeline.SIMILAR)
    group = {r["doc_id"]: r["component_id"] for r in found.collect()}
    words = {r["doc_id"]: r["text"].lower().split() for r in docs.select("doc_id", "text").collect()}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    near = [(i, j) for i in sets for j in sets if i < j and 0.8 <= len(sets[i]) / max(1, len(sets[j])) <= 1.25 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 50 and all(group[i] == group[j] for i, j in near)


def test_no_true_link_is_lost_near_the_least_similarity(spark, monkeypatch):
    """Families of texts with similarities around 0.8: the groups are those of all pairs."""
    monkeypatch.setattr(simhash, "REACH", 1)  # several rounds
    monkeypatch.setattr(simhash, "FURTHER", 3)
    rng = random.Random(17)
    texts = []
    for family in range(6):
        shared = [f"s{family}x{k}" for k in range(500)]
        texts += [" ".join(shared + [f"o{len(texts) + i}x{k}" for k in range(rng.randrange(59, 75))]) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(t.split()) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        before = list(want)
        for i in range(len(texts)):
            want[i] = min(want[j] for j in range(i // 30 * 30, i // 30 * 30 + 30) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
        if want == before:
            break
    assert 10 < len(set(want)) < 150
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, 1, 28, 8).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_doubtful_links_leave_a_group_as_a_forest():
    """Every pair of a group is doubtful: fewer links than nodes leave, not a multiple of them."""
    rng = np.random.default_rng(31)
    n = 300
    s = np.repeat(rng.integers(1, 256, (1, simhash.BINS), dtype=np.uint8), n, axis=0)
    changed = rng.random(s.shape) < 0.105
    s[changed] = rng.integers(1, 256, int(changed.sum()), dtype=np.uint8)
    est = np.array([simhash.similarity(s, x) for x in s])
    assert ((est > 0.72) & (est < 0.88)).mean() > 0.95
    a, b, est = simhash._links_in(np.full(n, 7), np.arange(n), np.zeros(n, np.uint64), s, 28, 0.8, (0, simhash.REACH), None)
    assert (est != simhash.OPEN).all() and len(a) == n - 1


def families(rng, shared, own):
    texts = []
    for family in range(4):
        line = [f"s{family}x{k}" for k in range(shared)]
        texts += [" ".join(line + [f"o{len(texts) + i}x{k}" for k in range(rng.randrange(*own))]) for i in range(40)]
    return texts


@pytest.mark.parametrize("block", [4096, 20])
def test_groups_of_doubtful_links_are_those_of_all_pairs(spark, monkeypatch, block):
    """Where the best doubtful links fail, others decide, in large groups, too."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "REACH", 2)
    texts = families(random.Random(37), 400, (44, 62))
    sets = [set(t.split()) for t in texts]
    want = list(range(len(texts)))
    while True:
        before = list(want)
        for i in range(len(texts)):
            want[i] = min(want[j] for j in range(i // 40 * 40, i // 40 * 40 + 40) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
        if want == before:
            break
    assert 8 < len(set(want)) < 150
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, 1, 28, 8).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_whole_sets_decide_between_roots_with_few_links():
    nodes = np.arange(40)
    sets = [np.arange(i // 20 * 1000, i // 20 * 1000 + 100, dtype=np.int64) for i in range(40)]
    s = np.ones((40, simhash.BINS), np.uint8)  # estimates say that all are similar
    side = nodes % 2 == 1
    found = simhash._borne_out(nodes, np.zeros(40, np.uint64), s, nodes, side, sets, 28, 0.8)
    assert len(found) == 38 and all(a // 20 == b // 20 and side[a] and not side[b] for a, b in found)
