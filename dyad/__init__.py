"""dyad: relational pair analytics over multi-party event logs, on Spark DataFrames."""
