"""Operators: DataFrame in, DataFrame out.

They are lazy but for upserts and histories, which store a small intermediate
frame first so that its size is known and it is computed once.
"""
