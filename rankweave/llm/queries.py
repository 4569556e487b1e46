"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .exact_dedup import OP7_SQL, op7_exact_dedup
from .hard_negatives import op13_hard_negatives
from .license_scan import op5_license_scan
from .line_dedup import OP10_SQL, op10_line_dedup
from .near_dedup import op6_near_dedup
from .packing import op9_packing
from .piece_encoding import op2_piece_encoding
from .quality_model import op1_quality_classifier
from .quality_rules import op8_quality_rules
from .resampling import op12_importance_resampling
from .suffix_dedup import op4_suffix_dedup
from .token_shards import op3_token_shards
from .toxicity import op11_toxicity

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_piece_encoding": op2_piece_encoding,
    "op3_token_shards": op3_token_shards,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_near_dedup": op6_near_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {"op7_exact_dedup": OP7_SQL, "op10_line_dedup": OP10_SQL}
