"""lakegraph: raw files to an analysable knowledge graph, as Spark DataFrame operators."""
