"""Graph operators: views, traversals, shortest paths, flows, trees, packing problems, segments."""
