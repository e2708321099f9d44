"""riskloom: risk analytics for large source and text corpora, as Spark jobs."""
