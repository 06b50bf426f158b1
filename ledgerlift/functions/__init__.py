"""Column factories: decoders and encoders of field bytes, in built-in functions."""
