"""Operators for large-scale training-data pipelines.  Nothing outside this
subpackage imports it; it can be removed without touching the rest."""
