"""Operators of a training-data pipeline over the text tables. Nothing else in the library imports them."""
