"""Caches and limiters: as streams with state, and the same as batch windows and folds."""
