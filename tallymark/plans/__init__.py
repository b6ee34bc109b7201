"""The registered queries: the operators over the driver's tables, and SQL for them."""
