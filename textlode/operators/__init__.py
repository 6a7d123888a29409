"""DataFrame operators of the search engine."""
