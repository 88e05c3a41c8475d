"""Where audited text comes from, and where findings go."""
