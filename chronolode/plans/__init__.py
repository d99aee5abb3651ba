"""Whole runs: tables in, result folders out."""
