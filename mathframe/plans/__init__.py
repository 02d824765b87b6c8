"""Plans for grids and conditions."""
