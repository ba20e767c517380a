"""Live forms of the session, ratio and play-block measures."""
