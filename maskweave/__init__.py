"""maskweave: find, tokenize, restore and scan sensitive text with Spark DataFrames.

Every operator takes and returns DataFrames (or Column expressions) and runs as
Spark SQL expressions, joins, windows and aggregations.
"""

from maskweave.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
