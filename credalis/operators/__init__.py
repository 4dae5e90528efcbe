"""DataFrame operators. Every metric takes ``keys`` and returns one row per key."""
