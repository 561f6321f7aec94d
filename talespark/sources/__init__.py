"""Readers and writers: stories, documents, catalogs, logs, scripts, commits."""
