"""Operators of a training-data pipeline: quality, duplicates, tokens, personal data, licences, extraction, scoring, mixing, packing."""
