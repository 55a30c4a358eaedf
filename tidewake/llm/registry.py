"""All queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import (query_addresses, query_bpe, query_chat, query_codes, query_huffman, query_index, query_language, query_licenses, query_personal,
               query_phrases, query_repeats, query_simhash, query_topk)

MODULES = [query_bpe, query_personal, query_huffman, query_licenses, query_chat, query_index, query_topk, query_simhash,
           query_repeats, query_language, query_phrases, query_codes, query_addresses]
Q = {name: fn for module in MODULES for name, fn in module.Q.items()} | {"pipeline": corpus_pipeline.run}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
