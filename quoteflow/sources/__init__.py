"""Where frames come from and where ticks are kept."""
