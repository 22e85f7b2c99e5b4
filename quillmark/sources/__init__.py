"""Readers that bind tables to declared roles."""
