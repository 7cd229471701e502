import corpus_pipeline
from linkloom.llm import simhash
from pyspark.sql import functions as F


def test_stages_and_columns(spark, sf, docs):
    now, sizes = docs, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            now = after.cache()
            sizes.append(now.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    kept = {r["doc_id"]: r["text"] for r in now.collect()}
    assert len({t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in kept.values()}) == len(kept)
    assert simhash.near_duplicates(now).where("doc_id <> component_id").count() <= 3  # three-word fingerprints are another measure
    packed = after.groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: len(t.split()) + 1 for i, t in kept.items()}


def test_stages_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (odd_docs, no_docs):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
        assert (now.count() == 0) == (rows is no_docs)


def test_packed_sequences_follow_the_mix(spark, docs, sf, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.mixing.scheduled, "__defaults__", (None, 4, *corpus_pipeline.mixing.scheduled.__defaults__[2:]))
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    want = {r["row"]["doc_id"]: r["position"] for r in corpus_pipeline.mixing.scheduled(docs).collect()}
    rows = corpus_pipeline.pack(spark, mixed.repartition(7), sf).collect()  # row order is lost on the way
    assert {r["doc_id"]: r["position"] for r in rows} == want
    first = {}
    for r in rows:
        first[r["window"], r["nth"]] = min(first.get((r["window"], r["nth"]), 10**9), r["position"])
    assert [first[k] for k in sorted(first)] == sorted(first.values()) and len(first) > 50


def test_decisions_are_of_rows_not_of_ids(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(1, own(1)), (1, own(1)), (None, own(2)), (None, own(2)), (None, own(3)), (None, own(4) + " end"), (4, own(4)), (5, own(5)), (5, own(5) + " end"), (5, own(6)), (7, own(7)), (7, own(7).upper()), (None, own(8)), (None, own(8) + " end")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    def keys(d):
        return sorted((r["doc_id"] or 0, r["text"].lower().removesuffix(" end")) for r in d.collect())
    exact = corpus_pipeline.drop_exact_copies(spark, df, "")
    assert keys(exact) == sorted((0 if i is None else i, t.lower().removesuffix(" end")) for i, t in {t.lower(): (i, t) for i, t in rows}.values())
    near = [(1, own(1)), (0, own(2)), (0, own(3)), (4, own(4)), (5, own(5)), (5, own(6)), (7, own(7)), (0, own(8))]
    assert keys(corpus_pipeline.drop_near_copies(spark, exact, "")) == sorted(near) == keys(corpus_pipeline.drop_near_copies(spark, df, ""))
    score = corpus_pipeline.toxicity.score
    bad = {own(3), own(6)}
    def scored(rows, model, id_col="doc_id"):
        got = score(rows, model, id_col=id_col).drop("predicted")
        toxic = [r["key"] for r in rows.select(F.col(id_col).alias("key"), "text").collect() if r["text"] in bad]
        hit = F.lit(False)
        for k in toxic:
            hit = hit | F.col("doc_id").eqNullSafe(F.lit(k))
        return got.withColumn("predicted", hit.cast("int"))
    monkeypatch.setattr(corpus_pipeline.toxicity, "score", scored)
    left = corpus_pipeline.drop_toxic(spark, df, str(tmp_path))
    assert sorted(r["text"] for r in left.collect()) == sorted(t for _, t in rows if t not in bad)


def test_rows_whose_keys_collide_are_not_lost(spark, monkeypatch):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, own(i), "s") for i in range(6)] + [(2, own(2), "s"), (3, own(9), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def marked(docs):
        return docs.withColumn("_row_key", F.when(F.col("doc_id").isin(2, 3), F.lit(5)).otherwise(F.col("doc_id")).cast("long")), "_row_key"

    monkeypatch.setattr(corpus_pipeline, "_marked", marked)
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert sorted(map(tuple, got.collect())) == sorted(set(rows))
