"""Training-data operators: search, filtering, deduplication, formatting, mixing and sharding."""
