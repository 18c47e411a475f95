"""Container-file analytics on Spark: bytes become typed rows.

Layers, smallest first: ``functions`` (Column expressions made of Spark
built-ins), ``operators`` (DataFrame to DataFrame), ``sources`` (readers and
writers), ``plans`` (end-to-end queries with their SQL) and ``streaming``.
"""

__version__ = "0.1.0"
