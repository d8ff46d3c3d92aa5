"""Column functions: text, vectors, identifiers, labels, policies, model output and errors."""
