"""Landed feeds to tables. Each parser takes a table of documents and returns rows."""
