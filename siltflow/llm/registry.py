"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op9_decontamination
from .katz import op4_katz
from .langid import op3_language_id
from .mixing import op10_mixing
from .pii import op6_pii
from .quality import op8_quality_rules
from .simhash import op5_simhash
from .suffixdedup import OP1_SQL, op1_suffix_dedup
from .toxicity import op7_toxicity
from .urlfilter import OP2_SQL, op2_url_filters

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_url_filters, op3_language_id, op4_katz, op5_simhash, op6_pii, op7_toxicity, op8_quality_rules, op9_decontamination, op10_mixing)}
ORACLES: dict[str, str] = {"op1_suffix_dedup": OP1_SQL, "op2_url_filters": OP2_SQL}
