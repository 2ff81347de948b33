"""Queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from relevo.llm import (
    op1_language_id,
    op2_substring_dedup,
    op3_sentencepiece,
    op4_toxicity,
    op5_decontaminate,
    op6_token_pack,
    op7_simhash,
    op8_minhash_dedup,
    op9_warc,
    op10_pii,
    op11_periodic_runs,
    op12_hard_negatives,
    op13_pivotal_mix,
)

_MODULES = (op1_language_id, op2_substring_dedup, op3_sentencepiece, op4_toxicity, op5_decontaminate, op6_token_pack, op7_simhash, op8_minhash_dedup, op9_warc, op10_pii,
            op11_periodic_runs, op12_hard_negatives, op13_pivotal_mix)


def _name(module) -> str:
    return module.__name__.rpartition(".")[2]


#: Each module's query has the module's name.
QUERIES = {_name(m): getattr(m, _name(m)) for m in _MODULES}
ORACLE = {_name(m): m.ORACLE for m in _MODULES if getattr(m, "ORACLE", None)}
