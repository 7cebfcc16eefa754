"""Reading lots from files and writing result tables."""
