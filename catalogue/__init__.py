"""The registered queries: one per operator, over the given tables, each with its SQL."""
