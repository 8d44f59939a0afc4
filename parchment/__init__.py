"""Structured-document analytics on Spark: document model, routing, structure, fields, metrics, scores and job state."""
