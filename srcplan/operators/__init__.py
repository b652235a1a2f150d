"""Relational operators over changes, code facts, findings and plans."""
