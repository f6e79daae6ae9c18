"""A retrieval analytics engine on Spark: chunks, vectors, tokens and triples as tables, questions as batches."""
