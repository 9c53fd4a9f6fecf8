"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .additive_quant import op10_ann
from .decontamination import op1_decontamination
from .language_id import op8_language_id
from .license_scan import op9_license_scan
from .line_dedup import op2_line_dedup
from .minhash import op7_minhash
from .oracles import ORACLES
from .packing import op3_packing
from .quality import op4_quality
from .substring_dedup import op5_substring_dedup
from .token_counts import op6_token_counts

__all__ = ["ORACLES", "queries"]


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_line_dedup, op3_packing, op4_quality, op5_substring_dedup, op6_token_counts, op7_minhash, op8_language_id, op9_license_scan, op10_ann)}
