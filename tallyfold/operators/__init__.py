"""Operators on ledgers, state tables and run tables."""
