"""Operations of a large-scale training-data pipeline: deduplication, tokenising, scoring, packing.

Nothing outside this subpackage imports it.
"""
