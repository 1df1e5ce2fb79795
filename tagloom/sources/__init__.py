"""Readers and writers for the file formats of the corpus and of every intermediate table."""
