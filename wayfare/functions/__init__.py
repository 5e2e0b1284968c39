"""Column builders: geometry, text and display."""
