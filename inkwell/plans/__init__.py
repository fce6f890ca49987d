"""Whole plans: from fetched pages to packets, chunks, summaries and stored parts."""
