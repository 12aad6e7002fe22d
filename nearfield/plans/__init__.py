"""Table specifications and the nearest-neighbour plan builder."""
