"""Where dimensions and parameters come from."""
