"""Record tables for the driver's general tables."""
