"""tamis: content and entity screening over whole DataFrames."""
