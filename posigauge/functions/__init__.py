"""Column helpers: no DataFrame is touched here."""
