"""Readers and writers of the tab-delimited formats."""
