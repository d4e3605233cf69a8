"""See the package docstring of corvane for the layout."""
