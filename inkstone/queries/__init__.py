"""One query for each operator of the inventory, bound to the driver's tables."""
