"""Scalar functions: text kernels, list statistics, and logit mathematics as column expressions."""
