"""Training-data operators: deduplication, quality, tokenising, packing, archives.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
