"""A training corpus in five stages: toxicity, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import bpe, line_dedup, mixing, near_copies, toxicity
from veilspan.llm.queries import RANKS, toxicity_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keep = COLUMNS[1:]
    return toxicity.score(docs, toxicity_model(docs, labels), keep=keep).filter("score < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that larger ids repeat."""
    out = line_dedup.dedup_lines(docs, keep=("lang", "source"))
    kept = F.col("kept")
    return out.select("doc_id", kept.alias("text"), "lang", "source", F.length(kept).cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, that of the smallest id (then text hash); rows without an id stay.

    Rows are linked where the Jaccard similarity of their five-word shingles is
    0.8 or more; each link is confirmed over the whole sets.  Rows of one id
    with different texts are rows of their own: only those linked to a kept row
    go.  Rows equal in id and text are one.
    """
    found = near_copies.near_copies(docs)
    heads = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select("row.*")
    kept = docs.withColumn("text_hash", F.xxhash64("text")).join(heads, ["doc_id", "text_hash"], "left_semi")
    kept = kept.dropDuplicates(["doc_id", "text_hash"])
    unnamed = docs.filter(F.col("doc_id").isNull())
    return kept.select(*COLUMNS).unionByName(unnamed.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; those of small sources up to twice, towards equal sources."""
    out = mixing.mix_sources(docs, mixing.Mix(max_repeats=2.0), keep=("text", "lang", "n_chars"))
    return out.select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of what they decode to."""
    from public_tokenizers import PATTERN, path

    return bpe.round_trip(docs, path(RANKS), PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("encoding", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again by the next."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="corpus-")
    folder = f"{shared.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
