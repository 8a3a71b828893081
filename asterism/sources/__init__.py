"""Reading tables and star views, and writing results."""
