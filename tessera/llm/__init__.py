"""Training-data operators: packing, scanning, deduplication, scoring, search and extraction over text tables."""
