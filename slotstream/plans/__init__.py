"""Query plans: the catalogue of named queries and their SQL counterparts."""
