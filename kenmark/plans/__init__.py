"""Plan helpers: written intermediate tables and skew-aware joins."""
