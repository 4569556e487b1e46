"""Relational operators: index build, search, fusion, reranking."""
