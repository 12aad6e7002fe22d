"""Scalar vector functions and quantizers."""
