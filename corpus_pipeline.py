"""The corpus pipeline: stages that each read what the one before wrote.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the
columns of documents. Rejected by the classifier, near copies but one of each group, and holders of
benchmark passages go; personal data is replaced; what is left is mixed to target weights, each
document as often as its source's budget takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import scratch, scratch_path
from quern.llm.decontam import drop_contaminated
from quern.llm.mixing import mix_documents
from quern.llm.neardup import drop_near_duplicates
from quern.llm.pii import redact_personal_data
from quern.llm.quality import keep_good
from quern.plans.common import remove

STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_documents),
]

#: SQL can't express the fitted classifier; the tests hold run() against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written and read again, and its scratch tables and its input removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)  # no later stage reads it
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
