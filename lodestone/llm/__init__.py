"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface; :mod:`lodestone.llm.queries` derives the registered
``opN_*`` queries from them and :mod:`lodestone.llm.oracles` holds their SQL.
"""
