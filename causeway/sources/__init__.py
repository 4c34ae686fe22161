"""Readers and writers of indicator files, statements, models, links and timings."""
