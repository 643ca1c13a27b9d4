"""Fits and transforms of feature tables: scaling, principal components, mixtures, thresholds, trees, sensitivity."""
