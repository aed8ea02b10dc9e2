"""Where images come from, and what their headers say."""
