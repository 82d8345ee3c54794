"""End-to-end runs and the registered queries."""
