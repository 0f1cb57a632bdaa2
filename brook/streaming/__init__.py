"""Structured Streaming jobs: the ELT on newly landed files, article dedup
across runs, windowed error rates and change-only latest status."""
