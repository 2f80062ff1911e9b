"""lexatlas: a Spark-first engine for text-reuse detection over large document corpora."""
