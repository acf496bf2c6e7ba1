"""Training-data operators over ``documents`` and ``conversations``.

Nothing else in the library imports this subpackage.  ``queries`` registers
one query per operator, ``oracles`` holds their DuckDB text where SQL can
express them.
"""
