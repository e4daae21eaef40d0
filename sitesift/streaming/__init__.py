"""Incremental (Structured Streaming) form of the extraction job."""
