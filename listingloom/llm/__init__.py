"""Training-data operators: near and exact dedup, tokenizing, extraction, scoring, sharding.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
