"""Column functions: text normalisation, token attributes, hashing, prompt rendering."""
