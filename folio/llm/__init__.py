"""Training-data operators: one module per operator, queries gathered in :mod:`folio.llm.catalog`.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
