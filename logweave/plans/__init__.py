"""Compositions of operators (pipelines) and the registered query set."""
