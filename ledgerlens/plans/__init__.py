"""Plan shapes Catalyst does not find by itself: shared scans, sliced order, exact ranks."""
