"""Black-and-white conversion and toning of images held as DataFrames of pixels."""
