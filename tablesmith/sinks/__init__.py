"""Writers. All write directories of part files in parallel; nothing is merged into one file."""
