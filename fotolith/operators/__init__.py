"""Relational operators of the catalogue: search, collections, rules, albums, keywords, indexing, retention."""
