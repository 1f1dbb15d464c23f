"""Training-data operators: quality, mixing, sharding, deduplication, toxicity, decontamination, licences."""
