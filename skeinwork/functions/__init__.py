"""Column functions: identifiers, text, similarity, scoring."""
