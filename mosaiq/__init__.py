"""A DataFrame-native engine for tile-transform image coding and the analytics around it."""

__version__ = "0.1.0"
