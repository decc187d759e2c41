"""Column functions: content digests and Student t."""
