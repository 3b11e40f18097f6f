"""Column expressions: text, dates, identity, URLs, and clinical text."""
