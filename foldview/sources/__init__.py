"""Record schemes, readers' options, archives."""
