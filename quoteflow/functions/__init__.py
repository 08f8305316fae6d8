"""Column functions: text in, typed values out, all inside Catalyst."""
