"""Guards on inputs and results, and composed plans."""
