"""Tessera: context analytics over documents, logs and conversations on Spark."""
