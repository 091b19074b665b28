"""Column functions over signals and prices."""
