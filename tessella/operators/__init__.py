"""Operators on units and weighted items: joins, weights, selection, vocabularies, encodings, scaling, splits, metrics."""
