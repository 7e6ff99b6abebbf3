"""End-to-end tables composed from the operators."""
