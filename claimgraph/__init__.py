"""claimgraph: a provenance-first knowledge engine on Spark DataFrames."""
