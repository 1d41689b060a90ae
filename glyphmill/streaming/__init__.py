"""Lexing of streams."""
