"""revsift: screening and extraction evaluation for literature reviews, on Spark.

Every public function takes and returns DataFrames (or Columns); none creates a
session. See README.md for the operator map.
"""

__version__ = "0.1.0"
