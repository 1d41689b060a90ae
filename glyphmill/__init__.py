"""Bulk lexing on Spark: a token specification is compiled once, then whole tables of text are lexed."""
