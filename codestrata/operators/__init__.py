"""DataFrame-to-DataFrame operators. All are lazy and run no action."""
