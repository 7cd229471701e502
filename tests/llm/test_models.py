import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import language, maxscore, quality, queries, toxicity
from linkloom.llm.common import fold

BIG = "/root/testdata/sf0.1"


def area(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held(spark, frame, column):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    got = frame.join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(column).alias("y")).toPandas()
    return got["y"].to_numpy(), got["score"].to_numpy(), got["predicted"].to_numpy()


def test_toxicity_held_out(spark):
    y, s, p = held(spark, queries.op4_toxicity(spark, BIG), "toxic")
    assert area(y, s) > 0.93 and (p == y).mean() > 0.97 and ((p == 1) & (y == 0)).sum() <= 0.005 * len(y)


def test_quality_held_out(spark):
    y, s, p = held(spark, queries.op10_quality(spark, BIG), "quality")
    assert area(y, s) > 0.99 and (p == y).mean() > 0.97


def test_language_held_out(spark, sf, docs):
    got = queries.op6_language_id(spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98 and got["score"].between(0, 1).all()


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, 0, 1), (None, 1, 1), (99, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    learn = fold(F.col("doc_id"), 5) >= 0
    model = toxicity.learn(odd_docs, labels, learn)
    for rows in (toxicity.score(odd_docs, model), quality.score(odd_docs, quality.learn(odd_docs, labels, learn))):
        got = rows.collect()
        assert len(got) == 11 and all(0 <= r["score"] <= 1 and r["held_out"] is False for r in got)
    assert toxicity.score(no_docs, toxicity.learn(no_docs, labels.limit(0), learn)).collect() == []
    assert quality.score(no_docs, quality.learn(no_docs, labels.limit(0), learn)).collect() == []


def test_folds_are_crc32_of_the_id_as_text(spark):
    import zlib

    got = spark.range(50).select("id", fold(F.col("id"), 3).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in got)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4)))
    at, x = np.array([5, 9, 9, 70]), rng.normal(size=4)
    plain = m.bias + sum(m.w[a] * v for a, v in zip(at, x, strict=True)) + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    more = np.array([3, 70]), np.ones(2)
    assert m.raw([at, more[0], at], [x, more[1], x])[[0, 2]] == pytest.approx(plain)


def test_language_odd_rows(spark, odd_docs, no_docs):
    profiles = language.learn(odd_docs, F.lit(True))
    got = {r["doc_id"]: r for r in language.identify(odd_docs, profiles).collect()}
    assert sorted(profiles) == ["de", "en"]
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[8]["lang_pred"] == "und" and got[7]["lang_pred"] == "de"
    assert language.identify(odd_docs, {}).where("lang_pred <> 'und'").count() == 0
    assert language.learn(no_docs, F.lit(True)) == {} and language.identify(no_docs, profiles).collect() == []


def test_profiles_against_plain_counts(monkeypatch):
    text = "Étés à l'été, x1y"
    words = ["étés", "à", "l", "été", "x", "y"]
    line = " " + " ".join(words) + " "
    want = {}
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g != " " and not (n == 3 and g[1] == " "):
                want[g] = want.get(g, 0) + 1
    for piece in (1 << 20, 4):
        monkeypatch.setattr(language, "PIECE", piece)
        keys, counts = language.ngrams(language._spaced(text))
        got = {}
        for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
            chars = [k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF]
            got["".join(chr(x) for x in chars if x)] = c
        assert got == want


def plain_top(vectors, k):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_maxscore_against_plain_search(spark, monkeypatch):
    rng = np.random.default_rng(2)
    common = rng.normal(size=8).tolist()
    rows = [(i, common if i % 3 == 0 else (rng.normal(size=8) * (rng.random(8) < 0.6)).tolist()) for i in range(400)]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (600, [float("inf")] * 8), (700, []), (701, [0.5]), (800, [0.0] * 8), (None, common)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard, block in ((8192, None), (50, 2)):
        monkeypatch.setattr(maxscore, "SHARD", shard)
        got = maxscore.top_k(maxscore.integer_vectors(table), F.col("vec_id") % 100 == 0, 10, block)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == plain_top(rows, 10)
    assert maxscore.top_k(maxscore.integer_vectors(table.limit(0)), F.lit(True)).collect() == []


def test_maxscore_prunes(monkeypatch):
    """Rows on no essential list are never scored."""
    rng = np.random.default_rng(3)
    x = np.zeros((2000, 64), np.int64)
    for r in x:
        r[rng.choice(64, 3, replace=False)] = rng.integers(1, 50, 3)
    q = np.r_[np.full(2, 1000), np.ones(62)].astype(np.int64)
    shard = maxscore.Shard(np.arange(2000), x)
    ids, scores = shard.top(-1, q, 10)
    order = np.lexsort((np.arange(2000), -(x @ q)))[:10]
    assert ids.tolist() == order.tolist() and scores.tolist() == (x @ q)[order].tolist() and len(shard.lists) < 64


def test_maxscore_of_large_components(spark):
    """Products beyond a long on the way, or by a bound that is not met; and none of them is wrong or an error."""
    big = 1_000_000_000
    rows = [(0, [big] + [0] * 63), (1, [big] + [1] * 63), (2, [-big] * 64), (3, [3 * big, 3 * big]), (4, [3 * big, -3 * big]), (5, [big, 5])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in maxscore.top_k(vectors, F.col("vec_id").isin(0, 4), 3).collect()}
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    for q in (0, 4):
        plain = sorted(((i, product(v, rows[q][1])) for i, v in rows if i != q), key=lambda x: (-x[1], x[0]))
        assert [got[q, r] for r in (1, 2, 3)] == plain[:3]
    with pytest.raises(Exception, match="does not fit a long"):
        maxscore.top_k(vectors.unionByName(spark.createDataFrame([(6, [4 * big, 4 * big])], "vec_id long, v array<bigint>")), F.col("vec_id") == 3, 3).collect()
