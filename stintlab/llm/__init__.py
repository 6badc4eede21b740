"""Operators for preparing language-model training data on Spark.

One module per operator; ``queries.py`` registers them for the driver. Nothing else in the
library imports this package.
"""
