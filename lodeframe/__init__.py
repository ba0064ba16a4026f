"""lodeframe: analytics over code repositories and text corpora, written as Spark DataFrame plans."""
