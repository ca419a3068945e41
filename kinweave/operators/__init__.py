"""Linkage, preparation, sampling, metrics, features, models and the evidence pool."""
