"""Operators for building training corpora at scale.

Conventions shared by all modules: an operator takes DataFrames and column
names, reads only the columns it names (extra or clashing ones are ignored) and
returns the columns its docstring lists. A word is a run of anything but the six
ASCII white-space characters 0x20 and 0x09-0x0D.
"""
