"""tidemark: influence analytics on large probabilistic graphs, expressed as Spark DataFrame plans."""
