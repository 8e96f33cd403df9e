"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .html import op5_html
from .lines import OP8_SQL, op8_line_dedup
from .neighbours import op10_nearest
from .packing import op7_packing
from .pii import op3_pii
from .quality import op2_quality_rules
from .repeats import op9_repeats
from .sentencepieces import op4_sentencepiece
from .simhash import op6_simhash
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_html": op5_html,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_repeats": op9_repeats,
    "op10_nearest": op10_nearest,
}

ORACLE_SQL: dict[str, str] = {"op8_line_dedup": OP8_SQL}
