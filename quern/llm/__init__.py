"""Training-data operators: scoring, token output, hygiene and deduplication of document corpora.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` registers the thin queries.
"""
