"""Operators for text corpora: sharding, scans, de-duplication, language model, formatting, tokenising."""
