"""A PySpark engine for catalogues of titles and the colour palettes of their artwork."""
