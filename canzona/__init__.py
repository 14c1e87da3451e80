"""Sequence prior-art analytics on Spark: figures, stratified counts, lattices, graphs and integrity reports."""
