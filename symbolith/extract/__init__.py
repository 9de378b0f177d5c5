"""Extraction of definitions from source text, one module for each family of languages."""
