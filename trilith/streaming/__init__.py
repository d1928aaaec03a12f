"""The query languages have no stream operators: results stream to the driver by Engine.rows()."""
