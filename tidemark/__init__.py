"""tidemark: market, portfolio and corpus analytics as Spark DataFrame plans."""
