"""The queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from . import ann, chat_format, decontaminate, ngram_join, packing, quality, secret_scan, toxicity, url_filter, warc

QUERIES = {
    "op1_quality": quality.op1,
    "op2_toxicity": toxicity.op2,
    "op3_url_filter": url_filter.op3,
    "op4_secret_scan": secret_scan.op4,
    "op5_chat_format": chat_format.op5,
    "op6_ngram_join": ngram_join.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_ann": ann.op8,
    "op9_packing": packing.op9,
    "op10_warc": warc.op10,
}

#: The others can't be written in SQL; tests/llm holds them against brute force.
ORACLES = {"op3_url_filter": url_filter.OP3_SQL, "op4_secret_scan": secret_scan.OP4_SQL, "op5_chat_format": chat_format.OP5_SQL, "op6_ngram_join": ngram_join.OP6_SQL, "op10_warc": warc.OP10_SQL}
