"""Reading and writing tables and files, and the catalog."""
