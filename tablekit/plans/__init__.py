"""Physical-layout helpers: size checks, durable layouts, skew-safe joins and running totals."""
