"""Progressive evaluation over growing inputs, change logs and interaction."""
