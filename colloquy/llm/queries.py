"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

from .ann import op9_ann
from .bpe import op1_byte_bpe
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .langid import op6_language
from .licenses import OP4_SQL, op4_licenses
from .line_dedup import op10_line_dedup
from .packing import op8_packing
from .simhash import op5_simhash
from .toxicity import op2_toxicity
from .url_filter import OP3_SQL, op3_url_filter

QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op2_toxicity": op2_toxicity, "op3_url_filter": op3_url_filter, "op4_licenses": op4_licenses, "op5_simhash": op5_simhash, "op6_language": op6_language, "op7_exact_dedup": op7_exact_dedup, "op8_packing": op8_packing, "op9_ann": op9_ann, "op10_line_dedup": op10_line_dedup}
ORACLE_SQL = {"op3_url_filter": OP3_SQL, "op4_licenses": OP4_SQL, "op7_exact_dedup": OP7_SQL}
