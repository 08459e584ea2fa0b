"""Conversation memory over tables and streams, as Spark DataFrames."""
