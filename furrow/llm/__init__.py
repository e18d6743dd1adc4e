"""Training-data operators: formatting, deduplication, cleaning, search, mixing."""
