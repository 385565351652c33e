"""The three end-to-end chains built from the operators."""
