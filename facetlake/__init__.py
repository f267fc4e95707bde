"""A Spark-first engine for element-level claims about indexed 3D assets.

Every operator takes and returns DataFrames; nothing here needs a database
file or a driver-side copy of the data.
"""

__version__ = "0.1.0"
