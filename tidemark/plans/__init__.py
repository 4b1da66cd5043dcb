"""Planning helpers: Z intervals and redundant filters that reach the file scan."""
