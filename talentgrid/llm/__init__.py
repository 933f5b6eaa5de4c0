"""Training-data operators: cleaning, deduplication, scoring and packaging of text at scale.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
