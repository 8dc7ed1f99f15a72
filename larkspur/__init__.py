"""larkspur: job-posting collection, scoring, deduplication and review as PySpark DataFrame operators."""
