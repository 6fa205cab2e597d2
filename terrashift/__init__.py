"""terrashift: DataFrame operators for spatial time-series studies of slowly moving ground."""
