"""Scalar functions: text, URL, HTML and presentation."""
