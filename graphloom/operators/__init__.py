"""Relational and iterative graph operators."""
