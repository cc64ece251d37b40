"""Operators of a training-data pipeline: counting, dedup, scoring, extraction, joins, packing, language."""
