"""Where tables come from and go to: sheets, configs, file routes, the corpus store."""
