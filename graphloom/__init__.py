"""graphloom: documents to knowledge graph to retrieval, as Spark DataFrame plans."""
