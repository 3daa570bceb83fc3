"""Query modules: operators applied to the canonical tables, each with its checking SQL."""
