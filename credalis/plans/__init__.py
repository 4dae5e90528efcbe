"""Views over the given tables, registered queries and composed studies."""
