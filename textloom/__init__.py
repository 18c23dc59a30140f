"""textloom: lexicon, text-task and metrics analytics expressed as PySpark plans."""
