"""Column expressions: text, rules and identities."""
