"""DataFrame in, DataFrame out: the operators of the recommendation jobs."""
