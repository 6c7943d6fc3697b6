"""Readers and the relational half of manifest building."""
