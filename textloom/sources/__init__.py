"""Workspaces as tables of files, and published snapshots of an index."""
