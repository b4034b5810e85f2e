"""Reading tables and files."""
