"""Queries of this subpackage, and SQL where SQL can express them."""

from cellspan.llm.alignment import op12_alignment
from cellspan.llm.chat import OP7_SQL, op7_chat
from cellspan.llm.decontaminate import OP3_SQL, op3_decontaminate
from cellspan.llm.divergence import OP11_SQL, op11_divergence
from cellspan.llm.huffman import op6_huffman
from cellspan.llm.main_text import op13_main_text
from cellspan.llm.mixing import op8_mixing
from cellspan.llm.near_dedup import op9_near_dedup
from cellspan.llm.packing import op5_packing
from cellspan.llm.pii import op2_pii
from cellspan.llm.quality_classifier import op1_quality
from cellspan.llm.quality_rules import op4_quality_rules
from cellspan.llm.secrets import op10_secrets

QUERIES = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_huffman": op6_huffman,
    "op7_chat": op7_chat,
    "op8_mixing": op8_mixing,
    "op9_near_dedup": op9_near_dedup,
    "op10_secrets": op10_secrets,
    "op11_divergence": op11_divergence,
    "op12_alignment": op12_alignment,
    "op13_main_text": op13_main_text,
}
SQL = {"op3_decontaminate": OP3_SQL, "op7_chat": OP7_SQL, "op11_divergence": OP11_SQL}
