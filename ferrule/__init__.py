"""Analytics over facts, rules and graphs, expressed as Spark jobs."""
