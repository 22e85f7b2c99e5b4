"""Definitions, decisions, digests and ledgers on the driver."""
