"""Plans that take several jobs: skew-safe lookups, distance counting, lineage cuts."""
