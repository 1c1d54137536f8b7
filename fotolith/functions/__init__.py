"""Column functions: text, hashes, natural order, colour."""
