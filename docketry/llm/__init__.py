"""Operators of a training-data pipeline over the ``documents`` table.

Each module holds one operator with a general interface; ``queries`` wires the
operators to the registered ``opN_<name>`` queries. Nothing outside this
subpackage imports it.
"""
