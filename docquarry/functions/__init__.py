"""Column functions: text, numbers, citations, arithmetic."""
