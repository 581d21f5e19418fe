"""Training-data operators: cleaning, deduplication, tokens, scoring, search and packing."""
