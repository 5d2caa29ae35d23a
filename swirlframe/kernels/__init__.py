"""NumPy kernels that run inside Arrow stages; none of them knows Spark."""
