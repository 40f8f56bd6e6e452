"""Named queries over the dataset's tables, with their SQL."""
