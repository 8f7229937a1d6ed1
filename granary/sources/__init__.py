"""Reading and writing tables, arrays and stores."""
