"""Streaming forms. The analysed job is batch only; the one streaming piece here
is incremental ingest of arriving trip files into cell-hour counts."""
