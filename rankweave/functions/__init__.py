"""Column-level building blocks: text analysis, URLs, similarity, embedding."""
