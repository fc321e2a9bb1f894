"""tarnwell: code and text retrieval, graph and memory analytics as Spark DataFrame operators."""
