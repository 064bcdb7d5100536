"""Training-data operators: cleaning, scoring, deduplication and encoding of a text corpus.

Nothing else in the library imports this subpackage; :mod:`slotstream.llm.registry`
lists its queries.
"""
