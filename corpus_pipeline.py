"""The corpus pipeline: filter, deduplicate, decontaminate, redact, mix.

Each stage takes the table its predecessor left and returns a DataFrame; all but the last
have the columns of documents. Every operator runs over all rows of its input.

Whatever the stage: a null text counts as empty, a null id as an id of its own, a repeated row as a
copy; further columns pass through whatever their names; an empty table stays empty. A column
copy of the input gives way to the mix's number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetward.llm import decontaminate, jaccard_join, mixing, pii, quality_rules
from fleetward.llm.common import released, shared_dir, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, empty ones among them; references are those of the documents at hand."""
    return quality_rules.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 join, the document of least id stays; texts without words all stay."""
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with every row of their id."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text give way to marks; n_chars is that of the new text, null where the text is null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered by the column copy."""
    return mixing.emit_mix(docs)


STAGES = [
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("PII", redact_personal_data),
    ("mixing", mix_sources),
]

#: SimHash windows, sampled paths and corpus references have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES[:-1]):
        path = f"{shared_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        # What a stage put into the shared folder goes once its result is there.
        with released(spark):
            out = step(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
