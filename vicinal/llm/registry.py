"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from vicinal.llm.align import op11_token_alignment
from vicinal.llm.bpe import op5_bpe_round_trip
from vicinal.llm.chat import OP3_SQL, op3_chat_format
from vicinal.llm.embed_dedup import OP7_SQL, op7_embedding_dedup
from vicinal.llm.fim import OP13_SQL, op13_fill_in_middle
from vicinal.llm.langid import op1_language_id
from vicinal.llm.media import op10_media
from vicinal.llm.mixing import OP8_SQL, op8_mixing
from vicinal.llm.quality import op9_quality
from vicinal.llm.sharding import OP12_SQL, op12_sharding
from vicinal.llm.simhash import op6_simhash_near_dedup
from vicinal.llm.substring import OP2_SQL, op2_substring_dedup
from vicinal.llm.urlfilter import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_url_filter": op4_url_filter,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_media": op10_media,
    "op11_token_alignment": op11_token_alignment,
    "op12_sharding": op12_sharding,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_chat_format": OP3_SQL,
    "op4_url_filter": OP4_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op12_sharding": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
