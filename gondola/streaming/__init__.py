"""The same queries kept up to date over a stream of feeds."""
