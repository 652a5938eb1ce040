"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from .byte_cnn import op10_byte_cnn
from .chat_format import op5_chat_format
from .decontaminate import op2_decontaminate
from .jaccard_join import op1_ngram_jaccard
from .lattice_lm import op4_lattice_lm
from .line_dedup import OP3_SQL, op3_line_dedup
from .packing import op9_pack
from .quality_rules import op6_quality_rules
from .suffix_dedup import op8_suffix_dedup
from .warc_zst import OP7_SQL, op7_warc

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_chat_format": op5_chat_format,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_pack": op9_pack,
    "op10_byte_cnn": op10_byte_cnn,
}
ORACLE: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op7_warc": OP7_SQL}
