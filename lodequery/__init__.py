"""Search, crawl and classification analytics as DataFrame transformations."""
