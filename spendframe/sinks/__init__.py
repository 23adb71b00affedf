"""Writers.  All of them write a directory of part files in parallel."""
