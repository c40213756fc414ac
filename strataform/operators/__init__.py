"""DataFrame-to-DataFrame operators: joins, ranking, scoring, quality, spatial."""
