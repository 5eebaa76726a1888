"""Sextant: document-intelligence and analytics operators as Spark DataFrame plans."""
