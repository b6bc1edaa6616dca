"""The corpus pipeline: quality filter, near-duplicate removal, substring dedup, mixing of sources, tokenisation.

Each stage takes (spark, docs, sf_dir) and gives the columns of documents (the last: token ids); run() writes each stage's
rows as Parquet under the shared folder and reads them again for the next one.

Defined cases are those of the operators: null and empty texts are scored like any text, are linked with nothing, have no
words to take (so the mix leaves them out) and no ids; repeated rows are one group; an empty table gives an empty result. Columns beyond
doc_id, text and source go through a stage as one struct, so that none of their names can clash with an operator's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import anchor_dedup, bpe, mixing, ngram_join, quality
from tidewell.session import stored


#: Columns that operators work on.
OWN = ("doc_id", "text", "source")


def _packed(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stage makes of docs, with docs' columns in their order; the stage sees OWN and, as "carried", all others."""
    others = [c for c in docs.columns if c not in OWN]
    carried = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("carried")] if others else []
    out = stage(docs.select(*OWN, *carried))
    return out.select(*[F.col(c) if c in OWN else F.col("carried").getField(c).alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    return _packed(docs, lambda d: quality.score(d, model, to="score").where(F.col("score") >= quality.THRESHOLD))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of linked ones."""
    return _packed(docs, ngram_join.representatives)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat a passage of an earlier document go; n_chars follows."""
    kept = _packed(docs, anchor_dedup.dedup)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return _packed(docs, lambda d: mixing.taken_times(d).where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers), ids_sha256, decoded_sha256."""
    vocabulary = bpe.default_vocabulary()
    decoded = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text"), vocabulary).drop("text"), vocabulary)
    return decoded.select(
        "doc_id",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]
#: A trained model and a flow decide which rows stay; SQL has neither. The tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
