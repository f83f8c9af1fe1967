"""Reading and writing catalogs, objects, commits, conflicts and migrations."""
