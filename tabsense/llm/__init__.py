"""Training-data operators: exact and near duplicates, mixing, scans, quality,
token counts, sharding, packing.  Nothing else in the library imports this package."""
