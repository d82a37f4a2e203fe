"""vietloom: Spark-first curation, review and evaluation of text-normalisation data."""
