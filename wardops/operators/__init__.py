"""Relational building blocks shared by queries and change rules."""
