"""Training-data operators: deduplication, decontamination, quality, packing, token files."""
