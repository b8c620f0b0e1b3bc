"""Whole jobs: from a zone to the next one."""
