"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .collocations import OP12_SQL, op12_collocations
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .filter_audit import OP11_SQL, op11_filter_audit
from .html_text import op6_html_text
from .mixing import OP8_SQL, op8_source_mixing
from .near_dedup import op9_near_dedup
from .neighbours import op3_permutation_search
from .packing import op10_best_fit_packing
from .quality import op13_quality
from .repeats import op2_repeat_removal
from .secrets import op7_secret_scan
from .token_frames import op1_token_frames
from .toxicity import op4_toxicity

QUERIES = {
    "op1_token_frames": op1_token_frames,
    "op2_repeat_removal": op2_repeat_removal,
    "op3_permutation_search": op3_permutation_search,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html_text": op6_html_text,
    "op7_secret_scan": op7_secret_scan,
    "op8_source_mixing": op8_source_mixing,
    "op9_near_dedup": op9_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_quality": op13_quality,
}

ORACLE = {
    "op5_exact_dedup": OP5_SQL,
    "op8_source_mixing": OP8_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
