"""Reading and writing tables: corpora, split CSVs, synthetic tables, metrics."""
