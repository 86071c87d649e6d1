"""End-to-end studies and the registered queries."""
