"""Column expressions: text, language selection, class vectors and labels."""
