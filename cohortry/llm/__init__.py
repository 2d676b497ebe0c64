"""Operators that prepare text corpora for training, built on Spark.

Nothing else in the library imports this subpackage.
"""
