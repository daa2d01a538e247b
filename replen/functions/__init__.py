"""Column functions: SKU parts, calendar and change ratios."""
