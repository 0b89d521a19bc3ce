"""Concept-evolution analytics on Spark: declarative DataFrame operators over a document corpus."""
