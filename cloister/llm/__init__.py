"""Training-data operators: formatting, filtering, deduplication, indexing and output."""
