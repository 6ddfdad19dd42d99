"""Curation, selection and evaluation of ordered image-like datasets as Spark DataFrames."""

__version__ = "0.1.0"
