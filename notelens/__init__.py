"""Corpus analytics on Spark: sectioned text, vocabularies, acronym senses.

Operators take and return DataFrames, name their ordering keys and draw all
randomness from hashes of row keys, so results repeat on any cluster layout.
"""
