"""The registered queries on the benchmark tables and their SQL counterparts."""
