"""What the operators are configured with for the movie data, and the order of its stages."""
