"""Multi-resolution spatial analytics over point sweeps, as Spark DataFrames."""
