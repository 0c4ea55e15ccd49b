"""Training-data operators: fingerprints, deduplication, classifiers, packing, mixing and archives."""
