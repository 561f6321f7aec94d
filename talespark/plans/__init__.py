"""End-to-end plans over the operators."""
