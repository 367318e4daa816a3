"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from quantloom.llm import bpe, chat, embeddings, licenses, lines, media, minhash, mixing, quality, sharding

MODULES = (media, bpe, chat, licenses, mixing, sharding, quality, lines, embeddings, minhash)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
