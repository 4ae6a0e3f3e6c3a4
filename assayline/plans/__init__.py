"""Registered queries, their SQL, and workflows made of operators."""
