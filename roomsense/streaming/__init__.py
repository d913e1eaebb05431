"""Structured Streaming jobs: ingest (I01-I09), hourly tiles (I11) and alert
raising (I12)."""
