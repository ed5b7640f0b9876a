"""The registered queries, the tables derived for them, and their checking SQL."""
