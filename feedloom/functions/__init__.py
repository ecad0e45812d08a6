"""feedloom subpackage."""
