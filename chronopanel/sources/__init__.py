"""Readers, writers, table fingerprints, staging jobs and the star-schema adapter."""
