"""pagemark: tables and streams of web pages to a scored Markdown corpus, on Spark."""

__version__ = "0.1.0"
