"""The queries of this subpackage, by name, and the SQL for those that have some."""

from __future__ import annotations

from .audit import op11_filter_audit
from .brown import op8_brown
from .collocations import op12_collocations
from .exact import op13_exact_dedup
from .linededup import op4_line_dedup
from .maintext import op2_main_text
from .minhash import op10_minhash
from .packing import op9_packing
from .quality import op7_quality
from .sharding import op1_resharding
from .sql import SQL
from .suffixes import op6_repeats
from .templates import op3_decontamination
from .tokencount import op5_token_counts

QUERIES = {
    "op1_resharding": op1_resharding,
    "op2_main_text": op2_main_text,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_repeats": op6_repeats,
    "op7_quality": op7_quality,
    "op8_brown": op8_brown,
    "op9_packing": op9_packing,
    "op10_minhash": op10_minhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_exact_dedup": op13_exact_dedup,
}

__all__ = ["QUERIES", "SQL"]
