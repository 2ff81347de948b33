"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``; the last returns doc_id, n_tokens, ids and the text that the ids decode to.

- language_id drops texts without a language (no letters, or no language likelier than all others together).
- minhash_dedup keeps the document with the smallest id of each group of near copies (five-word shingles, 0.8).
- decontaminate drops documents that repeat a benchmark item, also with other names, numbers and units.
- pii replaces personal data in the texts.
- sentencepiece encodes the texts.

Null and empty texts have no language and go in the first stage; null ids pass through every stage; an empty table
stays empty; columns beside those of ``documents`` are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relevo.llm.op1_language_id import language_stage
from relevo.llm.op3_sentencepiece import sentencepiece_stage
from relevo.llm.op5_decontaminate import decontaminate_stage
from relevo.llm.op8_minhash_dedup import dedup_stage
from relevo.llm.op10_pii import pii_stage
from relevo.session import materialize

STAGES = [
    ("language_id", language_stage),
    ("minhash_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("sentencepiece", sentencepiece_stage),
]
#: Language ID is fitted and the ids come from a model file, so SQL can't state the rows of ``run``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again, so a lost executor repeats one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
