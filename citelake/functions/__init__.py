"""Scalar and row functions: Spark columns where Spark has the operation, pure Python (wrapped by Arrow UDFs) where not."""
