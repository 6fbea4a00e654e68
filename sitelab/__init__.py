"""sitelab: labelling, splitting, sampling and ranking of candidate events on Spark."""
