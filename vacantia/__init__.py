"""Job-posting ingest, match, score and triage on PySpark DataFrames."""
