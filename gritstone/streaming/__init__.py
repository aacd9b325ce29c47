"""Nothing here yet: the workloads that this engine serves are batches, without watermarks or state."""
