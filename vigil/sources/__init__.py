"""Readers: driver tables, recorded runs, text logs, label-state files."""
