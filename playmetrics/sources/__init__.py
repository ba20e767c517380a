"""Reading event logs and tables, writing results."""
