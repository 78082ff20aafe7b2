"""Table readers, writers and the stage store."""
