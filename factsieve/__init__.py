"""Label-driven extraction over a crawled page corpus, expressed as Spark tables."""
