"""The collection API, and queries with their SQL."""
