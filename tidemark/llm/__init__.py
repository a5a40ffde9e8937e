"""Operators for training-data pipelines: text deduplication, scanning, scoring, mixing and packing."""
