"""tessera: spatial, graph, sequence and stateful analytics as Spark DataFrame plans."""
