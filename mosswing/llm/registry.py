"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op5_adaptive_scan
from .decontaminate import op3_qgram_lemma
from .licenses import op4_diagonal_voting
from .lm_score import op1_stupid_backoff
from .near_dedup import op6_order_minhash
from .packing import op2_best_fit_packing
from .pii import op7_surrogates
from .quality import op9_additive_model
from .sharding import op10_histogram_sort
from .toxicity import op8_weak_supervision

QUERIES = {
    "op1_stupid_backoff": op1_stupid_backoff,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_qgram_lemma": op3_qgram_lemma,
    "op4_diagonal_voting": op4_diagonal_voting,
    "op5_adaptive_scan": op5_adaptive_scan,
    "op6_order_minhash": op6_order_minhash,
    "op7_surrogates": op7_surrogates,
    "op8_weak_supervision": op8_weak_supervision,
    "op9_additive_model": op9_additive_model,
    "op10_histogram_sort": op10_histogram_sort,
}

ORACLE_SQL: dict[str, str] = {}
