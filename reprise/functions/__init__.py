"""Column functions and lexers."""
