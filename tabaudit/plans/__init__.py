"""End-to-end plans for two domains, made of the operators only."""
