"""Tables, generators, model inference and converters."""
