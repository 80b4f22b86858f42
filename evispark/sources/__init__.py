"""Reading and writing: landed files, chunk and vector tables, run history."""
