"""End-to-end jobs built from the operators."""
