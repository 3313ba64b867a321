"""Building blocks that hold up when one key has a large share of the rows."""
