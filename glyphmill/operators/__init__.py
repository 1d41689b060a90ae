"""Single steps of lexing as operators on tables: lines, pages, candidates, winners, tokens, coverage, transport."""
