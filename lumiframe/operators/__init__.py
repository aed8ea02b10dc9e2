"""DataFrame -> DataFrame operators over the canonical frames."""
