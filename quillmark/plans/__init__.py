"""Canonical views and registered queries."""
