"""brindle subpackage."""
