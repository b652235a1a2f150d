"""Refactoring plans: registry, steps, normal form, identity, validation."""
