"""Operators that prepare text for language-model training.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame plus column names, selects only the columns it
needs (so extra columns with clashing names do no harm) and returns a DataFrame.
"""
