"""Panel research on Spark: features, universes, weights, allocations and simulations over market bars."""
