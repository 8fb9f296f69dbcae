"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .conversation_repair import op13_conversation_repair
from .dart_minhash import op5_minhash_dedup
from .embedding_dedup import OP7_SQL, op7_embedding_dedup
from .html_extraction import op4_html_extraction
from .id_files import op2_id_files
from .license_scan import OP12_SQL, op12_license_scan
from .mixing import OP8_SQL, op8_mixing
from .quality_classifier import op3_quality_classifier
from .quality_rules import op6_quality_rules
from .secret_scan import op10_secret_scan
from .sentencepiece_codec import op9_sentencepiece
from .spelling_variants import op11_spelling_variants
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_id_files": op2_id_files,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_html_extraction": op4_html_extraction,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_mixing": op8_mixing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_secret_scan": op10_secret_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_license_scan": op12_license_scan,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op12_license_scan": OP12_SQL,
}
