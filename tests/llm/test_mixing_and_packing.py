import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from linkloom.llm import mixing, packing


def test_pattern_keeps_within_one_block():
    rng = random.Random(1)
    for n in (1, 2, 7, 40):
        for _ in range(5):
            q = mixing.quotas({str(i): rng.random() ** 3 + 0.001 for i in range(n)}, 512)
            assert sum(q.values()) == 512 and min(q.values()) >= 1
            slots = mixing.pattern(q, 512)
            assert sorted(s for x in slots.values() for s in x) == list(range(512))
            for s, at in slots.items():
                for t in range(513):
                    assert abs(sum(x < t for x in at) - t * q[s] / 512) < 1


def test_phases_use_every_block_once():
    rng = random.Random(2)
    blocks = {str(i): rng.randrange(0, 300) for i in range(9)} | {"one": 1, "huge": 5000}
    weights = {s: n**0.5 + 0.1 for s, n in blocks.items()}
    seen, last = [], {}
    for s, first, n, start, quota, size, slots in mixing.phases(blocks, weights, 128):
        assert last.get(s, 0) == first
        last[s] = first + n
        seen += [start + i // quota * size + slots[i % quota] for i in range(n)]
    assert last == {s: n for s, n in blocks.items() if n} and sorted(seen) == list(range(sum(blocks.values())))


def test_mix_against_simulation(spark, docs):
    weights = {r["source"]: 1.0 + int(r["source"][3:]) for r in docs.select("source").distinct().collect()}
    rows = sorted(mixing.scheduled(docs, weights, block_docs=4, period=256).collect(), key=lambda r: r["position"])
    assert len(rows) == docs.count() == len({r["position"] for r in rows}) == len({r["row"]["doc_id"] for r in rows})
    total, had, slots = sum(weights.values()), defaultdict(int), {}
    for r in rows:
        slots.setdefault(r["slot"], r["source_key"][1:])
    sizes = defaultdict(int)
    for s in slots.values():
        sizes[s] += 1
    quota = mixing.quotas({f"={k}": w for k, w in weights.items()}, 256)
    for t in range(len(slots)):  # until the first source runs out
        had[slots[t]] += 1
        if had[slots[t]] == sizes[slots[t]]:
            break
        for s in weights:
            assert abs(had[s] - (t + 1) * quota[f"={s}"] / 256) < 1
    assert total and t > 50


def test_mix_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs, block_docs=2)
    assert got.columns == odd_docs.columns and sorted(map(str, got.collect())) == sorted(map(str, odd_docs.collect()))
    assert mixing.mix(no_docs).collect() == []
    with pytest.raises(ValueError):
        mixing.scheduled(odd_docs, {"a": 1.0})


def plain_best_fit(lengths, costs, most):
    """Tries all bins for each item."""
    sizes, bins, left = sorted(costs), [], sum(lengths)
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            able = [c for c in sizes if c >= n]
            c = min([c for c in able if c <= most] or able[:1], key=lambda c: (costs[c] / min(c, left), c))
            bins.append(b := [c, 0])
        b[0] -= n
        b[1] += n
        left -= n
    return sum(min(costs[c] for c in sizes if c >= used) for _, used in bins)


def test_mix_does_not_depend_on_how_rows_arrive(spark):
    rows = [(None if i % 3 else i // 9, f"text {i}", "a" if i % 4 else None, {"k": i}) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tie map<string,int>")
    order = lambda d: [r["text"] for r in mixing.mix(d, block_docs=4).collect()]
    assert order(df.coalesce(1)) == order(df.repartition(7, "text").orderBy("text"))


def test_best_fit_against_plain_search():
    rng = random.Random(4)
    costs = {c: c * (1 + c / 40) for c in (8, 16, 32)}
    for _ in range(60):
        lengths = [rng.randrange(1, 33) for _ in range(rng.randrange(1, 60))]
        where, sizes = packing.best_fit(lengths, costs)
        used = defaultdict(int)
        for n, b in zip(lengths, where, strict=True):
            used[b] += n
        assert all(used[b] <= sizes[b] for b in used) and len(used) == len(sizes)
        assert all(sizes[b] == min((c for c in costs if c >= used[b]), key=costs.get) for b in used)
        assert sum(costs[c] for c in sizes) == pytest.approx(min(plain_best_fit(lengths, costs, m) for m in costs))


def check(rows, lengths, costs):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece_start"], r["length"]))
        bins[r["bin_id"]].append((r["start"], r["length"], r["capacity"]))
    for d, n in lengths.items():
        at = 0
        for start, size in sorted(pieces[d]):
            assert start == at
            at += size
        assert at == n
    for b in bins.values():
        at = 0
        for start, size, _ in sorted(b):
            assert start == at
            at += size
        assert len({c for *_, c in b}) == 1 and at <= b[0][2] and not any(c >= at and costs[c] < costs[b[0][2]] for c in costs)


def test_pack_keeps_every_token(docs):
    rows = packing.pack(docs, shard_docs=200).collect()
    check(rows, {r["doc_id"]: len(r["text"].split()) + 1 for r in docs.collect()}, packing.COSTS)
    used = sum(r["length"] for r in rows)
    assert used > 0.9 * sum({r["bin_id"]: r["capacity"] for r in rows}.values())


def test_pack_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, costs={8: 8.0, 16: 15.0}).collect()
    assert sum(r["length"] for r in rows) == sum(len((r["text"] or "").split()) + 1 for r in odd_docs.collect())
    assert packing.pack(no_docs).collect() == []


def test_pack_in_order_keeps_every_token_and_the_order(spark):
    rng = random.Random(6)
    lengths = {i: rng.choice([1, 3, 8, 16, 17, 40, rng.randrange(1, 90)]) for i in range(500)}
    df = spark.createDataFrame([(None if i % 50 == 7 else i, n, i * 2) for i, n in lengths.items()], "doc_id long, n long, position long")
    costs = {8: 8.0, 16: 15.0}
    rows = [r.asDict() | {"doc_id": r["position"] // 2} for r in packing.pack_in_order(df.repartition(5), costs, 64).collect()]
    check(rows, lengths, costs)
    first = {}
    for r in rows:
        assert r["window"] == r["position"] // 64 and r["bin_id"] == f"w{r['window']}-{r['nth']}"
        first[r["window"], r["nth"]] = min(first.get((r["window"], r["nth"]), 10**9), r["position"])
    assert [first[k] for k in sorted(first)] == sorted(first.values())
    assert packing.pack_in_order(df.limit(0)).collect() == []


def test_slots_follow_the_weights_however_many():
    rng = random.Random(8)
    for n in (2, 8, 50):
        rows = {str(i): rng.randrange(10_000, 1_000_000) for i in range(n)}
        weights = {s: x**0.7 for s, x in rows.items()} | {"tiny": sum(x**0.7 for x in rows.values()) * 1e-4}
        slots, end = mixing.exact_slots({s: x // 64 for s, x in rows.items()} | {"tiny": 10**6}, weights)
        assert end > 2000 and sorted(t for x in slots.values() for t in x) == list(range(end))
        total = sum(weights.values())
        for s, x in slots.items():
            for had, t in enumerate(x):  # just before and after each block
                assert abs(had - t * weights[s] / total) < 1 + 1e-6 and abs(had + 1 - (t + 1) * weights[s] / total) < 1 + 1e-6
            assert abs(len(x) - end * weights[s] / total) < 1 + 1e-6


def test_mix_of_many_sources(spark):
    df = spark.range(24_000).selectExpr("id AS doc_id", "concat('s', id % 12000) AS source")
    assert mixing.scheduled(df).select("position").distinct().count() == 24_000


def test_odd_lengths_are_packed(spark):
    docs = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, -3), (5, 5000), (None, 7)], "doc_id long, n int")
    rows = packing.pack(docs, F.col("n")).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["length"]) for r in rows) == [(0, 0, 7), (1, 0, 5), (2, 0, 1), (3, 0, 1), (4, 0, 1), (5, 0, 4096), (5, 1, 904)]


def test_rows_of_one_id_are_dealt_to_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source"))
    want = sorted(r["position"] for r in mixing.scheduled(df).collect())
    assert want == list(range(2000))
    buckets = df.groupBy(F.pmod(mixing.row_hash(df), F.lit(40))).count().agg(F.max("count"), F.count("*")).first()
    assert buckets[0] < 100 and buckets[1] == 40
