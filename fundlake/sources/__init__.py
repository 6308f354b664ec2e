"""Reading and writing tables, web tables, positional sheets and request plans."""
