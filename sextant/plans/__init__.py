"""Plans that put operators together: corpus build, catalog, registered queries."""
