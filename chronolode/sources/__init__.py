"""Readers of exported facts and writers of results."""
