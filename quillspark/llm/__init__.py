"""Training-data operators: archives, decontamination, packing, quality, deduplication, redaction and formatting."""
