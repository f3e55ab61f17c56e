"""Training-data operators: mixing, filtering, deduplication, search and tokenisation."""
