"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, jaccard_join, media, packing, prefix_trie, quality, secrets, source_divergence, token_files, toxicity, url_filter, vector_join

MODULES = [chat_format, packing, quality, media, bpe, toxicity, secrets, token_files, url_filter, jaccard_join, source_divergence, vector_join, prefix_trie]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in getattr(m, "SQL", {}).items()}
