"""Corpus operators; queries and SQL are gathered in quantloom.llm.registry."""
