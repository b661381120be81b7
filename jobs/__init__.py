"""Runnable jobs: each module has a function that takes a session, and a command line."""
