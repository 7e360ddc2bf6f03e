"""The registered queries: Spark callables and their SQL counterparts over the same tables."""
