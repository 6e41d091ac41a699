"""Operators of a training-data pipeline over large text tables.

One module per operator; ``queries`` registers them. Nothing outside this
package imports it, except the guarded import in ``__spark_entry__.py``.
"""
