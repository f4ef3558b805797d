"""The registered queries of this subpackage and the SQL that says the same where SQL can."""

from __future__ import annotations

from .op1_pii import op1_pii
from .op2_lines import ORACLE_SQL as LINES_SQL
from .op2_lines import op2_lines
from .op3_mixing import op3_mixing
from .op4_simhash import op4_simhash
from .op5_embedding import ORACLE_SQL as EMBEDDING_SQL
from .op5_embedding import op5_embedding
from .op6_bpe import op6_bpe
from .op7_fingerprint import op7_fingerprint
from .op8_language import op8_language
from .op9_html import op9_html
from .op10_substrings import ORACLE_SQL as SUBSTRINGS_SQL
from .op10_substrings import op10_substrings

QUERIES = {"op1_pii": op1_pii, "op2_lines": op2_lines, "op3_mixing": op3_mixing, "op4_simhash": op4_simhash, "op5_embedding": op5_embedding, "op6_bpe": op6_bpe, "op7_fingerprint": op7_fingerprint, "op8_language": op8_language, "op9_html": op9_html, "op10_substrings": op10_substrings}

ORACLES: dict[str, str] = {"op2_lines": LINES_SQL, "op5_embedding": EMBEDDING_SQL, "op10_substrings": SUBSTRINGS_SQL}
