"""Plans: the compiler's stages as lazily built tables."""
