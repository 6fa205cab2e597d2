"""Readers and writers. Schemas are declared; NaN becomes null where data come in."""
