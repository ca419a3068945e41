"""Operators for preparing large training collections; nothing outside this package imports it."""
