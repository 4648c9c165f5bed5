"""See the package docstring of telequay."""
