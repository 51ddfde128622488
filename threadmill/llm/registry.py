"""What __spark_entry__ registers: a query for each operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from threadmill.llm import op1_quality_rules, op2_chat, op3_classifier, op4_decontamination, op5_pii, op6_minhash, op7_sharding, op8_warc, op9_language, op10_bpe

MODULES = (op1_quality_rules, op2_chat, op3_classifier, op4_decontamination, op5_pii, op6_minhash, op7_sharding, op8_warc, op9_language, op10_bpe)


def queries():
    return {m.NAME: m.query for m in MODULES} | {"pipeline": lambda spark, sf_dir: corpus_pipeline.run(spark, sf_dir)}


def oracles():
    found = {m.NAME: m.ORACLE for m in MODULES if getattr(m, "ORACLE", None)}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
