"""The queries opN_<name> of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from ferrule.llm.chat import OP5_SQL, op5_chat_format
from ferrule.llm.decontam import op8_decontamination
from ferrule.llm.embedding_dedup import op1_embedding_dedup
from ferrule.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from ferrule.llm.html_text import op10_html_text
from ferrule.llm.line_dedup import OP7_SQL, op7_line_dedup
from ferrule.llm.minhash import op4_minhash
from ferrule.llm.mixing import op6_mixing
from ferrule.llm.quality import op3_quality
from ferrule.llm.substring_dedup import OP13_SQL, op13_substring_dedup
from ferrule.llm.toxicity import op2_toxicity
from ferrule.llm.warc_zip import op9_warc
from ferrule.llm.whitening import op11_whitening

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_minhash": op4_minhash,
    "op5_chat_format": op5_chat_format,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_html_text": op10_html_text,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLES = {"op5_chat_format": OP5_SQL, "op7_line_dedup": OP7_SQL, "op12_hard_negatives": OP12_SQL, "op13_substring_dedup": OP13_SQL}
