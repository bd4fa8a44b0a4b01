"""From statements to DataFrames, and the registered queries."""
