"""Reading and writing recordings, samples, targets and weights."""
