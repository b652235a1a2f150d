"""Scanners of source text, in plain Python: what the engine needs of a language, not whole grammars."""
