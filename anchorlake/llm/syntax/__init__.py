"""Syntax of source files: chart parsing with repair of least cost."""
