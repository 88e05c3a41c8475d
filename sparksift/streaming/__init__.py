"""Audits of files that keep arriving."""
