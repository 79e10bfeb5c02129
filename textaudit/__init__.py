"""textaudit: writing-quality audit, pair integrity, governance and event queries on Spark DataFrames."""
