"""Helpers that decide how plans are run: materialising, partition counts, fixpoints."""
