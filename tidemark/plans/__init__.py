"""Plan building on the driver: grids of bins and the choice of a source layer."""
