"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from treelace.llm import decontam, warc
from treelace.llm.bpe import op3_bpe
from treelace.llm.decontam import op6_decontaminate
from treelace.llm.embdedup import op2_embedding_dedup
from treelace.llm.langid import op1_language_id
from treelace.llm.quality import op8_quality
from treelace.llm.sharding import op7_kd_shards
from treelace.llm.simhash import op9_simhash
from treelace.llm.suffix import op4_suffix_dedup
from treelace.llm.urlfilter import op10_url_filter
from treelace.llm.warc import op5_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_bpe": op3_bpe,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_warc": op5_warc,
    "op6_decontaminate": op6_decontaminate,
    "op7_kd_shards": op7_kd_shards,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": warc.ORACLE,
    "op6_decontaminate": decontam.ORACLE,
}
