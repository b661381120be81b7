"""Plans that compose operators, and the registered queries with their SQL."""
