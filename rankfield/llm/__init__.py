"""Operators for text corpora: deduplication, decontamination, scans, scoring, packing, chat."""
