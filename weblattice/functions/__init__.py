"""Part of weblattice."""
