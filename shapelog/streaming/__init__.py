"""The same work over logs that keep growing."""
