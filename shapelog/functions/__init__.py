"""Row-level helpers: name patterns, type text, JS literals."""
