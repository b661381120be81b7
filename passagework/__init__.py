"""A Spark-native engine for document parsing, chunking, indexing, retrieval and evidence-checked answers."""
