"""Operators for building large text corpora: tokens, archives, rules, duplicates, secrets, packing, media, url filters.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
