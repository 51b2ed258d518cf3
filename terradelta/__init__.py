"""Land-surface change detection over pixel tables, expressed as Spark DataFrames."""
