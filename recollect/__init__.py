"""Retrieval, memory and text analytics over tables and folders of text, on Spark."""
