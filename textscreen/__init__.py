"""Spark-native staging, curriculum, featurising and evaluation of labelled text."""

__version__ = "0.1.0"
