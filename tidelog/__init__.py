"""An event-log engine on Spark: ordered, sequence-numbered logs as DataFrames over Parquet segments and a versioned manifest."""
