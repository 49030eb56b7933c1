"""Part of leadflow; see the README for the layout."""
