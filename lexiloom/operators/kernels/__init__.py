"""Assembly kernels: pure functions over one island's byte strings, in first-occurrence order."""
