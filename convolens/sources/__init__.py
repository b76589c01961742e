"""Readers and writers of the file layouts the operators work on."""
