"""Where graphs come from and go to: builders, generators, test-table graphs, DOT text."""
