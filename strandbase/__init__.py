"""Collections, vectors, graphs and their query language as DataFrame plans."""
