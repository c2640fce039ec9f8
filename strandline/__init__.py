"""strandline: a Spark-first engine for corpus and graph analytics."""
