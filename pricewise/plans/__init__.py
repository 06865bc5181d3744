"""Composed queries: the registry of every operator as a runnable query plus its oracle."""
