"""The registered queries: test-table bindings, Spark plans and their SQL counterparts."""
