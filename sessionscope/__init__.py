"""Active-session-history analysis of database workloads on Spark DataFrames."""
