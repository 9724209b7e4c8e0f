"""Staging, silver and gold models, the build over them, and serving queries."""
