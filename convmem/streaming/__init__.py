"""Streaming operators: state per conversation."""
