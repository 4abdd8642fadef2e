"""Column-level functions (no shuffles): html, urls, text, errors, formatting."""
