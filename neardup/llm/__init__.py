"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it; the registered queries are in
``queries.py`` and their DuckDB SQL in ``sql.py``.
"""
