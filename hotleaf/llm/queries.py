"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from hotleaf.llm.decontaminate import OP8_SQL, op8_decontaminate
from hotleaf.llm.language_id import op10_language_id
from hotleaf.llm.line_dedup import OP6_SQL, op6_line_dedup
from hotleaf.llm.lm_score import op2_lm_score
from hotleaf.llm.packing import op5_packing
from hotleaf.llm.quality_rules import OP3_SQL, op3_quality_rules
from hotleaf.llm.simhash_dedup import op4_simhash
from hotleaf.llm.substring_dedup import op7_debruijn_dedup
from hotleaf.llm.suffix_dedup import op1_suffix_dedup
from hotleaf.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_debruijn_dedup": op7_debruijn_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_decontaminate": OP8_SQL,
}
