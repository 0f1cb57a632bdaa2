"""Scans and sinks: manifests, payload acquisition, feed parsing, the raw
landing zone, the curated Parquet store and the quarantine."""
