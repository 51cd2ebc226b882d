"""Reading and writing tables, and the shapes that queries read."""
