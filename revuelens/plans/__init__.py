"""Catalogue of runnable queries and the SQL each is checked against."""
