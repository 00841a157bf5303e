"""From raw documents to encoded training text, stage by stage.

Each stage takes the rows that the one before has kept, written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlay.llm.langid import identifier
from coverlay.llm.mixing import mix, mixed_texts
from coverlay.llm.pieces import encode_texts, load_vocabulary
from coverlay.llm.quality import quality_model, quality_score
from coverlay.llm.queries import VOCABULARY
from coverlay.llm.superminhash import keep_one
from coverlay.operators.lineage import shared_folder

#: Quality scores below this are rejected; words of a block that the mix moves as one.
ACCEPTED, BLOCK_WORDS = 0.3, 256
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("_score", quality_score(model)).filter(F.col("_score") >= ACCEPTED).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with enough certainty."""
    return docs.withColumn("_judged", identifier(docs).judge()).filter(~F.col("_judged.rejected")).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id, nulls last."""
    return keep_one(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each pass over a source, what it takes of a document."""
    return mixed_texts(docs, mix(docs, block_words=BLOCK_WORDS)).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, its three best segmentations' scores, and the round trip."""
    return encode_texts(docs.select("doc_id", "lang", "source", "text"), load_vocabulary(VOCABULARY)).drop("text")


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("MinHash near-dedup", deduplicate),
    ("mixing sources", mixing),
    ("SentencePiece encoding", encoding),
]

#: Learned models and hashed draws are not for SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
