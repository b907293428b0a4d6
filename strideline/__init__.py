"""Labelled sensor time series on Spark: cleaning, segmentation, features, motifs, models."""
