"""Where lines, declarations and overrides come from."""
