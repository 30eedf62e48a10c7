"""The corpus pipeline: quality rules, line dedup, near dedup, benchmark decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; run() writes each stage's rows as a Parquet
table in the shared folder and reads them back as the next stage's docs. What a stage needed is deleted once the next one is
written; the last stage's tables stay, since its rows are read by the caller.

Defined cases, by stage: null or empty text fails the base rules of quality, so it goes; line dedup takes rows of one doc_id as one
document and gives each its own text; near dedup and decontamination take different texts of one doc_id as documents of their own, or
as one where any of them is contaminated; rows with equal id and text stand once after near dedup; in packing each row has its
own pieces. A null doc_id is the smallest. Columns other than doc_id and text pass through all stages but the last, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriven.llm.common import drop_written, n_written, table, written
from scriven.llm.decontam import decontam_stage
from scriven.llm.line_dedup import line_stage
from scriven.llm.near_dedup import near_stage
from scriven.llm.packing import packing_stage
from scriven.llm.quality import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontam_stage),
    ("packing", packing_stage),
]

#: Expectation-maximisation, similarity classes and packing have no SQL twin; tests/llm checks the run by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = table(spark, sf_dir, "documents"), n_written()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(spark, start, n_written() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
