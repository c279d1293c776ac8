"""Inputs and outputs: tables, payload logs, lenses over the driver tables, table writers."""
