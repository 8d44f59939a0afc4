"""Readers: provider output, manifests, truth, originals; and the report sinks."""
