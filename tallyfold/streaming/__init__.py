"""Jobs that follow growing ledgers."""
