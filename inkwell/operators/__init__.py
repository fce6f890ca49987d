"""Operators over DataFrames of documents: segmentation, chunks, summaries, extraction, gates, retrieval."""
