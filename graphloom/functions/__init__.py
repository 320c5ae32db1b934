"""Part of the typed-graph engine."""
