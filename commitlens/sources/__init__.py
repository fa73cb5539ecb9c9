"""Sources: the files of a tree, their text, and git's history of lines."""
