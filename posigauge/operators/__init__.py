"""DataFrame transforms, grouped by what they do."""
