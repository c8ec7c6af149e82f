"""reconlake: DataFrame operators for RGB-D observation and reconstruction-evaluation data."""
