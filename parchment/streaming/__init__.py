"""Incremental forms: de-duplicated uploads, latest corrections, and lease expiry."""
