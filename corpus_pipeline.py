"""A corpus pipeline: quality classifier, near duplicates, decontamination, personal data, tokens.

Each stage is written as Parquet in the shared folder and read again as the next one's documents. All but the last return
the columns of documents; what a stage rejects is gone for the next. SQL can't express the classifier, the signatures or
the encoding, so there is no oracle; tests/llm/test_pipeline.py compares run() with a statement of each stage by brute force.

Edge cases, beside those of each stage's operator: a null text counts as an empty one and stays null until it is tokenised;
a null id is an id (of the tokens' rows too); texts of any length go through whole; of rows with equal texts, or of near
copies, the one with the least id stays, and equal rows (ids too) are one; an empty table gives no rows; further columns,
whatever their names, stay up to the last stage.
"""

from __future__ import annotations

from threadmill.llm import op3_classifier, op4_decontamination, op5_pii, op6_minhash, op10_bpe
from threadmill.llm.common import shared_folder, table

STAGES = [
    ("quality", op3_classifier.stage),
    ("near_duplicates", op6_minhash.stage),
    ("decontamination", op4_decontamination.stage),
    ("personal_data", op5_pii.stage),
    ("tokens", op10_bpe.stage),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over documents; what the stages write goes when the application ends."""
    docs, to = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{to}/{name}")
        docs = spark.read.parquet(f"{to}/{name}")
    return docs
