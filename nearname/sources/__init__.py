"""Readers and writers: raw logs, lists, pair files, tables per site."""
