"""NumPy kernels over packed pages: what windows can't say. One page at a time, no shuffle."""
