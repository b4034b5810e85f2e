"""Table transformations: each takes a DataFrame and gives a DataFrame."""
