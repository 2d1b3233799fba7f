"""Row-wise derivations: no shuffle, no state, safe on any row alone."""
