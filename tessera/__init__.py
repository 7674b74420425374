"""Nearest-neighbour fraud scoring on Spark: parse, featurize, quantize, index, search, evaluate, stream."""
