"""A corpus from documents: toxic ones go, then exact and near copies; sources are mixed to target weights and packed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm import exact_dedup, mixing, packing, simhash, toxicity
from linkloom.llm.common import fold, fresh, small_batches, written

#: Near copies: five-word shingles, at a Jaccard similarity of SIMILAR or more. At 0.8 the cosine of the
#: shingle sets is 0.89 and 9.7 of 64 bits are expected to differ, with a deviation of 2.9; 28 bits are over six deviations
#: more, so the similarity decides, and the radius only spares most pairs of unlike texts (32 bits) its calculation.
SHINGLE, RADIUS, SKETCH, SIMILAR = 5, 28, 8, 0.8
#: Keys of rows to drop are broadcast up to this number (8 bytes each); beyond it the rows are shuffled to them.
BROADCAST_KEYS = 1_000_000


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of doc_id and text, and its name: what decisions go by, since ids may be null or shared. Of rows whose
    keys of 64 bits collide none is lost as a repeat of the other (see drop_near_copies); one that collides with a toxic row goes
    with it, which is expected of 0.05 rows where a hundredth of ten billion is toxic."""
    name = fresh(docs, "_row_key")
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")), name


def _one_each(rows: DataFrame, helper: str, *key: str | Column) -> DataFrame:
    """Of rows that share the key one stays, by a hash of the whole row; without the helper column."""
    nth = fresh(rows, "_nth")
    order = Window.partitionBy(*key).orderBy(mixing.row_hash(rows))
    return rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth, helper)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the model predicts to be toxic go, whatever rows share their id or have none, too. Learned from labels
    of the same fold as in the operator's query. Repeated rows stay repeated. A null or empty text has no evidence and
    stays; very long texts are scored whole; extra columns of any names are kept; an empty table gives an empty one."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 3) != 1)
    rows, key = _marked(docs)
    gone = fresh(rows, "_toxic")
    toxic, _ = written(toxicity.score(rows, model, id_col=key).where("predicted = 1").select(F.col("doc_id").alias(gone)).distinct(), "toxic")
    hint = "broadcast" if toxic.count() <= BROADCAST_KEYS else "shuffle_hash"
    return rows.join(toxic.hint(hint), F.col(key) == F.col(gone), "left_anti").drop(key)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z; null is empty) one row stays: that with the largest doc_id, a null one only if
    there is no other; of several with that id, one by a hash of the row. Very long texts are compared whole; extra columns
    of any names are kept; an empty table gives an empty one."""
    small_batches(spark)
    name = fresh(docs, "_digest")
    rows = docs.withColumn(name, exact_dedup.digest_of(F.col("text")))
    of_id, of_text = fresh(rows, "_kept_id"), fresh(rows, "_kept_digest")
    kept = exact_dedup.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias(of_id), F.col("digest").alias(of_text)).distinct()
    # null-safe, though no digest is null: for a plain equality Spark would filter by a digest of its own before
    rows = rows.join(kept.hint("shuffle_hash"), F.col(name).eqNullSafe(F.col(of_text)) & F.col("doc_id").eqNullSafe(F.col(of_id)), "left_semi")
    return _one_each(rows, name, "doc_id", name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join one row stays: that with the smallest doc_id, a null one only if there is no other; of
    several with that id, one by a hash. Rows that share an id but not the text are documents of their own. Texts without
    a word are one group; very long texts are compared whole; extra columns of any names are kept; an empty table gives an
    empty one."""
    rows, key = _marked(docs)
    found = simhash.near_duplicates(rows, shingle=SHINGLE, radius=RADIUS, sketch=SKETCH, id_col=key, similar=SIMILAR)
    found = found.select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    ids = rows.select(F.col(key).alias("row_key"), "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key")))
    of = fresh(rows, "_kept")
    kept = found.join(ids, "row_key").groupBy("component_id").agg(first.alias("first")).select(F.col("first.row_key").alias(of))
    rows = rows.join(kept.hint("shuffle_hash"), F.col(key) == F.col(of), "left_semi")
    return _one_each(rows, key, key, "doc_id", F.xxhash64(F.lit(19), "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: sources weigh their documents to the power mixing.POWER. Null and empty sources
    are sources; repeated rows, null ids, texts of any length and extra columns are kept; an empty table gives an empty one."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, in the order of the mix, which follows from the rows alone and is found again
    here: rows lose theirs when read. A null or empty text is one token long, a very long one fills several sequences;
    repeated rows and null ids are packed like others; extra columns play no part; an empty table gives an empty one."""
    mixed = mixing.scheduled(docs, carry=F.struct("doc_id", packing.tokens(F.col("text")).alias("n")))
    return packing.pack_in_order(mixed.select("row.*", "position"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("SimHash near-dedup", drop_near_copies), ("mixing sources", mix_sources), ("best-fit packing", pack)]

#: SQL can't express the learned model, fingerprints and schedules. The tests compare all rows of run() with a plain version
#: that goes by all pairs, and check each stage's rows for what must hold of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
