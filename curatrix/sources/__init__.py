"""Where relations come from and where they are kept."""
