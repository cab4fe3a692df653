"""Scalar functions: element-wise mathematics, dates and expression strings, as native columns."""
