"""The corpus pipeline: documents to token ids, a written table after each stage."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import bpe, decontam, runtime, simhash, suffix_dedup, toxicity
from gondola.llm.queries import table, tokenizer_path

#: Columns that all stages but the last hand on.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Null and empty texts score low and stay;
    repeated rows are judged alike; labels without a document or a value teach
    nothing, and with none of one kind everything stays. Columns beyond those of
    documents are not handed on, here and in all stages."""
    labels = table(spark, sf_dir, "labels").where(toxicity.learnable())
    lexicon = toxicity.fit_lexicon(docs.select("doc_id", "text"), labels)
    return toxicity.score_toxicity(docs.select(*COLUMNS), lexicon).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (sets of five-word shingles with a Jaccard
    similarity of 0.8 or more) the document with the smallest id stays. Null, empty
    and wordless texts have equal sets, so one of them stays, as of repeated rows; a
    null id is larger than all others; an empty table gives no rows."""
    return simhash.keep_one(docs.select(*COLUMNS), k=5, similarity=SIMILAR)


#: Jaccard similarity from which documents are near copies.
SIMILAR = Fraction(4, 5)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that also start in an earlier document go; a document of
    which nothing is left goes with them. Passages are bytes; a character that is cut
    through goes whole, all others stay as they are, U+FFFD too. Null and empty texts
    and texts without repeats stay; of equal texts under one id all do; a null id is
    later than all others; an empty table gives no rows."""
    found = suffix_dedup.remove_repeats(docs.select(*COLUMNS), 50, whole_characters=True)
    changed = F.col("n_removed") > 0
    kept = found.where("n_removed = 0 or octet_length(kept) > 0").withColumn("text", F.when(changed, F.col("kept").cast("string")).otherwise(F.col("text")))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words stand in 13-word windows
    of the benchmark go. The text alone decides, so rows are told apart by its hash:
    clean rows stay whatever other rows of their id hold, null ids included. Null and
    empty texts have no words and stay; with an empty benchmark all rows do."""
    docs = docs.select(*COLUMNS)
    index = decontam.build_index(docs.select(F.xxhash64("text").alias("_hash"), "text"), key="_hash")
    found = decontam.contamination(decontam.search(index, table(spark, sf_dir, "benchmark")))
    bad = runtime.written(found.where("contaminated").select(F.col("doc_id").alias("_hash")).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64("text") == F.col("_hash"), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the digests of the round trip: a row for each,
    repeated and null ids and null texts (no tokens) included."""
    return bpe.encode_documents(docs.select("doc_id", "text"), tokenizer_path()).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: No SQL states the trained lexicon, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = runtime.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
