"""Plan shapes that keep one hot key from landing in one task."""
