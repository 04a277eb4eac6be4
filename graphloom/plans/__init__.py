"""Execution helpers: sessions, stashes and bounded loops."""
