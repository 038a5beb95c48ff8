"""Text operators for preparing training data.

Nothing outside this package imports it. ``queries`` registers the thin queries
``op1_`` .. ``op10_`` and the pipeline.
"""
