"""placeforge: place gazetteers built, checked and queried with Spark DataFrames."""
