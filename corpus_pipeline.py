"""The corpus pipeline: language, repeated lines, near-duplicates, benchmark
passages, source mix.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the documents it keeps, which are written and read again as the
next one's. :func:`run` does so in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcube.llm import decontaminate, language, lines, mixing, simhash
from gridcube.llm.common import stage
from gridcube.plans.strategy import join_small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty and other texts without
    a letter. Where no language can be learned (no labelled document outside
    the held-out third, an empty table), all texts with a letter stay. Repeated
    rows fare alike; columns besides those of documents are left out."""
    docs = docs.select(*COLUMNS)
    trees = language.learn(docs.where(~language.held_out()))
    if trees is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.identify(docs, trees).where("language.lang_pred != 'und'").drop("language")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every line once in the corpus; all documents stay, also those left
    without a line, with a null or empty text, and repeated rows. ``n_chars``
    is counted anew where lines went."""
    unique = lines.dedup_lines(docs.select(*COLUMNS), wide=True)
    size = F.when(F.size("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return unique.withColumn("n_chars", size).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest id, of each group of near-duplicates.

    Rows are judged by id and fingerprint: where rows share an id, only those
    go whose own text has a near-duplicate under a smaller id. Null and empty
    texts are alike. Of rows equal in id and text one stays; documents without
    an id stay but for that."""
    docs = docs.select(*COLUMNS)
    found = stage(simhash.simhash_components(docs, shingle=4, max_bits=4).where("doc_id IS NOT NULL"), "pipeline-prints")
    goes = F.col("doc_id") != F.col("component_id")
    ids = stage(found.groupBy("doc_id").agg(F.max(goes).alias("some_go"), F.min(goes).alias("all_go")).where("some_go"), "pipeline-ids")
    whole = docs.join(ids.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    # ids that stay in part: few, and only the fingerprints of their rows are taken again
    mixed = ids.where("NOT all_go").select("doc_id")
    gone = found.where(goes).join(mixed, "doc_id", "left_semi").select("doc_id", "fingerprint").distinct()
    own = simhash.fingerprints(4)(F.coalesce("text", F.lit("")))
    part = join_small(docs, mixed, "doc_id", "left_semi").withColumn("fingerprint", own)
    part = join_small(part, gone, ["doc_id", "fingerprint"], "left_anti").dropDuplicates(["doc_id", "text"])
    return whole.select(*COLUMNS).unionByName(part.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages. Null and empty texts hold
    none; with an empty benchmark all stay; repeated rows fare alike."""
    marked = decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where("not contamination.contaminated").drop("contamination")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered in ``copy``. A null
    source is a source of its own; a null or empty text has no words; rows
    without an id are drawn by their text; repeated rows get equal numbers."""
    mixed = mixing.mix(docs.select(*COLUMNS).withColumn("size", mixing.words(F.col("text"))), content="text")
    return mixing.emit(mixed).select(*COLUMNS, "copy")


STAGES = [("language", identify_language), ("lines", dedup_lines), ("near-duplicates", dedup_documents),
          ("decontamination", drop_contaminated), ("mixing", mix_sources)]

#: SQL cannot express byte context trees, SimHash groups and edit-distance links.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
