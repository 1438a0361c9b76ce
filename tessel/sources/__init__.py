"""Tables in, tables out; the inputs elsewhere are frames."""
