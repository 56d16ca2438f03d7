"""Tables derived from the driver's data, the registered queries and their SQL twins."""
