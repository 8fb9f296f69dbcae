"""Operators of a training-data pipeline (WARC, tokens, quality, extraction,
near-duplicates, mixing, SentencePiece, secrets).  Nothing else in the library
imports this subpackage."""
