"""Named query plans over a table directory, and their SQL oracles."""
