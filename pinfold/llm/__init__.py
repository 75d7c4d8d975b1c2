"""Operators that prepare text for language models. Nothing else in the package imports this one."""
