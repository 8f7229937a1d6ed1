"""Tables, groups, indexes and arrays."""
