"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op2_byte_bpe
from .decontaminate import ORACLE as LEAK_SQL
from .decontaminate import op11_decontamination
from .exact_dedup import ORACLE as DEDUP_SQL
from .exact_dedup import op8_exact_dedup
from .hard_negatives import ORACLE as NEGATIVE_SQL
from .hard_negatives import op12_hard_negatives
from .hmm_lm import op6_hmm_scores
from .html_text import op7_html_text
from .importance import op4_importance_resampling
from .near_dedup import ORACLE as NEAR_SQL
from .near_dedup import op9_near_dedup
from .packing import op1_best_fit_packing
from .quality_rules import ORACLE as RULES_SQL
from .quality_rules import op3_quality_rules
from .spelling import ORACLE as SPELLING_SQL
from .spelling import op13_spelling_variants
from .token_counts import op5_token_counts
from .toxicity import op10_toxicity

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_token_counts": op5_token_counts,
    "op6_hmm_scores": op6_hmm_scores,
    "op7_html_text": op7_html_text,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_decontamination": op11_decontamination,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": RULES_SQL,
    "op8_exact_dedup": DEDUP_SQL,
    "op9_near_dedup": NEAR_SQL,
    "op11_decontamination": LEAK_SQL,
    "op12_hard_negatives": NEGATIVE_SQL,
    "op13_spelling_variants": SPELLING_SQL,
}
