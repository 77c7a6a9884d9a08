"""Training-data operators: filters, deduplication, scoring, mixing and packing."""
