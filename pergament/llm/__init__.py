"""Training-data operators: one module per operator, no import from the rest of the library."""
