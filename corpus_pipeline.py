"""A corpus from documents: five stages, each by an operator, each read by the next from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contactloom.llm.common import Tables, table
from contactloom.llm.stages import drop_near_duplicates, drop_toxic, drop_unknown_language, encode, mix_sources

STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Stages 1, 2 and 5 apply trained models and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables, last = table(spark, sf_dir, "documents"), Tables(spark, "pipeline"), []
    for name, stage in STAGES[:-1]:
        docs = tables.written(stage(spark, docs, sf_dir), name, last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
