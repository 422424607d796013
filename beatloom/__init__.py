"""Segment, token-sentence and label analytics for keyed time-series records, on Spark."""
