"""SQL pass-through, workload runs, rewrites compared, and ready-made table queries."""
