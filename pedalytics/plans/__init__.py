"""Wiring: table contexts, the stage runner, the query registry and its SQL oracles."""
