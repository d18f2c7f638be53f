"""A corpus pipeline: five stages, each of one training-data operator, over the documents table.

Each stage takes what the one before kept and is written as Parquet before the next.
Documents go whose toxicity reaches the cutoff that the model was calibrated to (`op3_toxicity.CLEAN`); of documents of equal text one stays, as
of near copies (Jaccard similarity of five-word shingles 0.8 or more); sources are mixed to
their targets, a document once for each of its copies; and the mix is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.jaccard import near_duplicates
from gridloom.llm.op3_toxicity import classify, fit, sample
from gridloom.llm.op4_grace_dedup import dedup
from gridloom.llm.op8_mixing import mix
from gridloom.llm.op9_sentencepiece import encode_decode

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least Jaccard similarity of near copies, in percent, and the words of a shingle.
NEAR = {"shingle": 5, "percent": 80}


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written once: a later scan that is split otherwise would number them otherwise."""
    return common.spool(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "pipeline-numbered")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(*sample(docs, common.table(spark, sf_dir, "labels")))
    return classify(docs, model, model.cutoff, carry=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def _without(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """rows less those that aren't kept; their numbers are sent to all tasks if they are few enough, so that texts stay in place."""
    gone = common.small(judged.where("not kept").select("_row"), "pipeline-dropped", common.MOST_IDS)
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    return _without(rows, dedup(rows, row="_row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash links obvious copies; an exact join of shingles adds what random bits miss (`jaccard`)."""
    rows = _numbered(docs)
    return _without(rows, near_duplicates(rows, "_row", **NEAR))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    copies = mix(rows, row="_row").where("copies > 0").select("_row", "copies")
    return rows.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]
#: Scores and random draws can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.spool(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
