"""Training-data operators.

Nothing outside this subpackage imports it.  Each module is one operator with
its own general interface; :mod:`barloom.llm.queries` binds them to tables.
"""
