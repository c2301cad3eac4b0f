"""Rule analytics over temporal graphs, expressed as Spark DataFrame plans."""
