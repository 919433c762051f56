"""NumPy kernels of one component, volume or skeleton; free of Spark."""
