"""Operators of a large-scale training-data pipeline, each a DataFrame-to-DataFrame job."""
