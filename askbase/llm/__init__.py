"""Operators for preparing training text at scale, each in a module of its own."""
