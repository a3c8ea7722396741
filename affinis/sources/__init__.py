"""Table readers and writers, and the stored table of vectors."""
