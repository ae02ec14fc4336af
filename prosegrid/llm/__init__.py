"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns DataFrames; intermediate tables go to the folder that the session
names in ``spark.checkpoint.dir``, which the driver and all executors share.
"""
