"""Artifact tables, configuration files, and the document views of the given tables."""
