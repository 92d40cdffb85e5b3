"""Operators of a training-data pipeline over document tables.

Nothing outside this package imports it; delete the folder and the rest of the
library still works.
"""
