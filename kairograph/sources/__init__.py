"""Readers of graphs and change logs, and writers of rules."""
