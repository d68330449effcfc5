"""Where deep images come from and go to."""
