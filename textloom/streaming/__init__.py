"""Structured Streaming: incremental ingest of tabular inputs."""
