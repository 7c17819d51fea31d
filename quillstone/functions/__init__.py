"""Document-intelligence operators."""
