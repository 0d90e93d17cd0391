"""What the primitives compute on local arrays."""
