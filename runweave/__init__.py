"""Run SQL over named data sources on Spark, and analyse what the runs did."""
