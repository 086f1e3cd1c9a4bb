"""One module per group of operators; importing one registers its queries."""
