"""Training-data operators: tokenising, filtering, deduplication, redaction,
sharding and packing of text corpora.  Nothing outside this package imports it."""
