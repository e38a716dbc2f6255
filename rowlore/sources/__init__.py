"""Readers: folders, delimited text, workbooks."""
