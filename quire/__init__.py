"""Page-note analytics on Spark: operators over books, pages, sections, notes and quotes."""
