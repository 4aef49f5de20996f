"""Views and endpoint queries over the two tables."""
