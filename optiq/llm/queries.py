"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from optiq.llm import chat, line_dedup, near_dedup, warc
from optiq.llm.bpe import op1_byte_bpe
from optiq.llm.chat import op3_chat_formatting
from optiq.llm.fingerprints import op4_fingerprints
from optiq.llm.language import op7_language_id
from optiq.llm.line_dedup import op11_line_dedup
from optiq.llm.mixing import op10_mixing
from optiq.llm.near_dedup import op5_near_dedup
from optiq.llm.quality import op8_quality
from optiq.llm.substring_dedup import op9_substring_dedup
from optiq.llm.token_counts import op6_token_counts
from optiq.llm.turn_repair import op13_turn_repair
from optiq.llm.warc import op2_warc
from optiq.llm.whitening import op12_whitening

QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_warc, op3_chat_formatting, op4_fingerprints, op5_near_dedup, op6_token_counts,
    op7_language_id, op8_quality, op9_substring_dedup, op10_mixing, op11_line_dedup,
    op12_whitening, op13_turn_repair)}

ORACLE: dict[str, str] = {"op2_warc": warc.ORACLE_SQL, "op3_chat_formatting": chat.ORACLE_SQL,
                          "op5_near_dedup": near_dedup.ORACLE_SQL, "op11_line_dedup": line_dedup.ORACLE_SQL}
