"""Readers and writers of the record, trace, quad and result formats."""
