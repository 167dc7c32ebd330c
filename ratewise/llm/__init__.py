"""Operators for preparing large text corpora (training-data pipelines).

One module per operator, each a plain function over DataFrames; the
registered queries and their SQL are in ``queries``.  Nothing else in the
library imports this package.
"""
