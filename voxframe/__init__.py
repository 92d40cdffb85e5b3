"""Volumetric analytics on Spark.

A volume is one row: its voxels as an array in C order, its shape, and a mask of
the same length. Operators turn volume rows into volume rows without a shuffle:
as Column expressions where these suffice, as Arrow-batched NumPy kernels where
not. Evaluation, catalogue, splits, routing and recovery are DataFrame plans.
"""
