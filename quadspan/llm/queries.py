"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_format
from .decontaminate import op9_decontamination
from .html import op4_html_text
from .lexical import OP11_SQL, op11_search
from .line_dedup import OP13_SQL, op13_line_dedup
from .mixing import op7_mixing
from .near_dedup import op1_near_dedup
from .orc import op10_token_ids
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op8_quality_rules
from .suffix import op6_suffix_dedup
from .token_counts import op2_token_counts
from .urls import OP3_SQL, op3_url_filters

QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_token_counts, op3_url_filters, op4_html_text, op5_chat_format, op6_suffix_dedup, op7_mixing, op8_quality_rules, op9_decontamination, op10_token_ids, op11_search, op12_prefix_trie, op13_line_dedup)}
ORACLE: dict[str, str] = {"op3_url_filters": OP3_SQL, "op5_chat_format": OP5_SQL, "op11_search": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_line_dedup": OP13_SQL}
