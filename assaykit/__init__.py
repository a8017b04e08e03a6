"""assaykit: evidence analytics over text corpora, change history and tables, on Spark."""
