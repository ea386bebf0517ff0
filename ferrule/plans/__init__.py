"""Named queries and how they are run under a budget."""
