"""SQL expression texts, for ``F.expr`` and ``selectExpr``.

Expressions are built as SQL text rather than as nested ``Column`` calls: the
wide conditional aggregates of a lag sweep would otherwise need thousands of
calls to the JVM before a job starts.
"""
