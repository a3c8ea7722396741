"""Column builders and the block kernels behind the pair operators."""
