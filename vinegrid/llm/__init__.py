"""Training-data operators: filtering, deduplication, sharding, packing, search."""
