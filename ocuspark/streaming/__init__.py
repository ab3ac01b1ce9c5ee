"""The same signal operators over streams."""
