"""DataFrame operators. None of them collects data-sized frames."""
