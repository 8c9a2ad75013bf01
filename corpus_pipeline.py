"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's docs.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; further columns, also such as
clash with names used inside, are dropped. Texts are handled whole, whatever their length; null texts and ids go through
(see each operator); repeated rows of an id leave the Jaccard join once; a tie at the quality threshold is accepted; an
empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoresieve.llm import decontam, jaccard, lines, mixing, quality
from scoresieve.llm.scratch import dropped, exists, shared_dir, spent, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learned from the labels of documents whose crc32(doc_id) mod 4 is not 2."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    out = quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return out.where("quality_predicted = 1").select(*COLUMNS)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least 10 of them share; n_chars follows the text."""
    out = lines.without_common_lines(docs, min_docs=10)
    return out.withColumns({"text": F.col("line_dedup.text"), "n_chars": F.length("line_dedup.text").cast("long")}).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles."""
    return jaccard.one_of_each(docs, shingle=5, num=8, den=10).select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at their source's target rate and shuffled; adds copy_no and order_key."""
    return mixing.mixed(docs).select(*COLUMNS, "copy_no", "order_key")


STAGES = [
    ("quality classifier", accepted),
    ("line dedup", without_common_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", uncontaminated),
    ("source mixing", mixed_sources),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The last stage's rows. What a stage stores for itself goes with its end, and its input once its output is whole.

    run_id: a name for the run, so that one that was broken off and is started again goes on after its last whole stage.
    """
    base = f"{shared_dir(spark)}/scoresieve/run-{run_id or uuid.uuid4().hex}"
    paths = [f"{base}/{i + 1}-{name.replace(' ', '-')}" for i, (name, _) in enumerate(STAGES)]
    done = max((i + 1 for i, path in enumerate(paths) if run_id and exists(spark, path)), default=0)
    docs = spark.read.parquet(paths[done - 1] if done else f"{sf_dir}/documents.parquet")
    if done:
        docs.stored_path = paths[done - 1]
    for i in range(done, len(STAGES)):
        name, stage = STAGES[i]
        with spent(spark):
            out = stored(stage(spark, docs, sf_dir), name, paths[i])
        dropped(docs)
        docs = out
    return docs
