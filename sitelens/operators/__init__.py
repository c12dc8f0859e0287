"""Relational, ranking, statistical and feature operators."""
