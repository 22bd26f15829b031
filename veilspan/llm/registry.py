"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontam import OP8_SQL, op8_decontamination
from .divergence import OP11_SQL, op11_source_divergence
from .html_extract import op6_html_extraction
from .mixing import OP9_SQL, op9_mixing
from .pii import op5_pii
from .pseudolikelihood import op10_lm_scoring
from .quality_rules import OP1_SQL, op1_quality_rules
from .resampling import OP12_SQL, op12_importance_resampling
from .rulefit import op2_quality_classifier
from .secret_scan import op13_secret_scan
from .simhash import op3_simhash_near_dedup
from .sharding import OP4_SQL, op4_sharding
from .suffix_dedup import OP7_SQL, op7_suffix_dedup


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_sharding": op4_sharding,
        "op5_pii": op5_pii,
        "op6_html_extraction": op6_html_extraction,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_decontamination": op8_decontamination,
        "op9_mixing": op9_mixing,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_source_divergence": op11_source_divergence,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_secret_scan": op13_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op4_sharding": OP4_SQL, "op7_suffix_dedup": OP7_SQL, "op8_decontamination": OP8_SQL, "op9_mixing": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_importance_resampling": OP12_SQL}
