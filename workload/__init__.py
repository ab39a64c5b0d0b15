"""Registered queries, each with its SQL form where SQL can state it."""
