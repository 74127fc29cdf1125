"""Training-data operators: ten dealt operators and their registered queries.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when the package is present.
"""
