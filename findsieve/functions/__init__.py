"""findsieve subpackage."""
