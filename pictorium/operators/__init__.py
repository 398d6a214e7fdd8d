"""DataFrame operators of the catalogue engine."""
