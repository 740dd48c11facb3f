"""Readers and writers: source trees, the versioned graph store, plan documents."""
