"""Column builders: projections, normalisations and banded scores."""
