"""Kernels over pixels, in numpy. They know nothing of Spark; operators.images runs them in it."""
