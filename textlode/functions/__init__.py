"""Column expressions for text and markup."""
