"""Column factories: text, vectors and scores."""
