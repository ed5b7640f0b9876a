"""Reading crawl tables, captures and fetch logs; writing results."""
