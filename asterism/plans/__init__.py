"""A serialisable relational plan and its compiler."""
