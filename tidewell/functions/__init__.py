"""functions of the retrieval engine."""
